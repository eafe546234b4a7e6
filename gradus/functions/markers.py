"""Word lists that steer the labelling of dialogue turns. Lists for other languages can be passed."""

from __future__ import annotations

from dataclasses import dataclass

# The Vietnamese lists.
PERSONA = [
    "thầy là ai", "thầy là gì", "thầy sẽ làm gì", "thầy làm gì", "thầy giúp gì", "bạn là ai",
    "chức vụ", "mấy tuổi", "bao nhiêu tuổi", "thạc sĩ", "tiến sĩ", "bằng cấp", "uy tín",
    "robot", "bot", "chatbot", "hello", "hi", "chào", "xin chào", "alo", "cảm ơn", "thanks",
    "người thật", "con người", "vai trò", "có vợ", "đẹp trai", "ăn cơm",
]
SKEPTIC = [
    "thạc sĩ", "tiến sĩ", "bằng cấp", "uy tín", "có chắc", "chắc không", "chắc chưa",
    "biết gì", "đòi", "xạo", "bịp", "dỏm", "tin được", "nhìn mặt",
]
FRUSTRATED = [
    "khó quá", "không hiểu", "ko hiểu", "chán", "bực", "nản", "mãi không", "bó tay", "điên",
]
VALIDITY = [
    "đề sai", "đề bài sai", "đề lỗi", "đề có vấn đề", "đề cho thiếu", "thiếu dữ kiện",
    "thiếu số liệu", "thiếu dữ liệu", "cho thiếu", "vô nghiệm", "không có đáp án", "đáp án sai",
    "đáp án bị sai", "lỗi hiển thị", "hiển thị lỗi", "không giải được", "không đủ dữ kiện",
    "đề thiếu",
]
TASK = [
    "vì sao", "tại sao", "sao lại", "công thức", "phương án", "đáp án", "bước", "tính", "giải",
    "gợi ý", "sai ở đâu", "chỗ nào", "định lý", "hiểu", "câu này", "bài này", "chọn",
    "ví dụ", "vi du", "minh họa", "minh hoa", "làm sao", "như thế nào", "giải thích", "hướng dẫn",
    "thầy ơi", "thầy chỉ", "tiếp theo", "cụ thể", "chi tiết", "là sao",
]
KNOWLEDGE = ["công thức", "định lý", "định nghĩa", "là gì", "cách tính", "khái niệm", "tính chất"]
PROBLEM = [
    "cho hàm số", "tích phân", "đạo hàm", "phương trình", "bất phương trình", "chứng minh",
    "tìm m", "tìm x", "giải giúp", "giải hộ", "bài toán", "tính giá trị",
]
CURIOUS = ["vì sao", "tại sao", "như thế nào", "là gì"]
STEP = ["bước", "gợi ý", "bắt đầu", "tiếp theo"]
PLACEHOLDER_STEMS = ["", "câu hỏi của học sinh", "câu hỏi ôn tập đgnl"]
GREETINGS = [
    "hi", "hello", "chào", "chao", "chào bạn", "chào thầy", "chào cô", "chào em", "alo", "helo",
    "hey", "hế lô", "bắt đầu", "start", "giúp em", "giúp em với", "xin chào", "good morning",
    "good evening", "hi gia sư", "chào gia sư", "thầy ơi", "thầy ơi giúp em", "dạ chào thầy",
    "chào thầy ạ", "em chào thầy", "em chào thầy ạ", "hi thầy", "hi bot",
]
META_QUESTIONS = [
    "thầy sẽ làm gì", "thầy làm gì", "thầy là ai", "thầy giúp gì", "bạn là ai", "bạn làm gì",
    "hướng dẫn", "cách học", "giúp gì được em", "socratic là gì", "quy tắc học",
    "vai trò của thầy",
]


def _default(words: list[str]) -> tuple[str, ...]:
    return tuple(words)


@dataclass(frozen=True)
class Markers:
    persona: tuple[str, ...] = _default(PERSONA)
    skeptic: tuple[str, ...] = _default(SKEPTIC)
    frustrated: tuple[str, ...] = _default(FRUSTRATED)
    validity: tuple[str, ...] = _default(VALIDITY)
    task: tuple[str, ...] = _default(TASK)
    knowledge: tuple[str, ...] = _default(KNOWLEDGE)
    problem: tuple[str, ...] = _default(PROBLEM)
    curious: tuple[str, ...] = _default(CURIOUS)
    step: tuple[str, ...] = _default(STEP)
    placeholders: tuple[str, ...] = _default(PLACEHOLDER_STEMS)
    greetings: tuple[str, ...] = _default(GREETINGS)
    meta: tuple[str, ...] = _default(META_QUESTIONS)
