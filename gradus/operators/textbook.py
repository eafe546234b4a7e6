"""Textbook pages: cleaning, audits, identity, structure carried from page to page.

``pages``: source_id, page_number, text. ``sources`` (defaults at the first page): source_id,
subject_code, grade, book_edition. ``nodes``: ord, subject_code, grade, chapter_name, lesson_name,
pattern_name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import contains_any, is_blank, strip, words_of
from gradus.operators.blocks import NODE_LIMITS, score_blocks, slices
from gradus.operators.ordered import bucket_of, carry_last
from gradus.session import checkpointed

# Lines of a page that carry no content.
NOISE_LINES = [
    r"^\d{1,3}$",
    r"(?iu)^(?:Hình\s+\d+[.\d]*|Ảnh\s+\d+|Nguồn\s*:)",
    r"(?iu)^(?:Hoạt động khởi động|Em có biết\??|Ghi chú hình)",
]
# Signs of a broken font encoding, vowels, and the limits of the test.
BAD_GLYPHS = "{}\\^~|¶§©®½¼¾¿±`¤°łĊīŤŠśřœżźčďńňħĈЎČГəÄÅÖĀŚĨŨÐþÑťĞï"
VOWELS = (
    "aăâeêioôơuưyáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
    "AĂÂEÊIOÔƠUƯYÁÀẢÃẠẮẰẲẴẶẤẦẨẪẬÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
)
MIN_AUDITED, MIN_BAD, MIN_BAD_SHARE = 30, 4, 0.008
MIN_LETTERS, MIN_VOWEL_SHARE = 30, 0.23
MIN_PAGE_CHARS, SCAN_SHARE = 40, 0.5
FRONT_PAGES, BACK_PAGES, SAMPLE_CHARS = 6, 3, 1500


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.filter(trimmed, lambda line: line != "")


def without_noise(text: Column) -> Column:
    def useful(line: Column) -> Column:
        noise = F.lit(False)
        for pattern in NOISE_LINES:
            noise = noise | line.rlike(pattern)
        return ~noise

    return F.array_join(F.filter(_lines(text), useful), "\n")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Adds clean_text and removed_lines (noise, blank lines not counted)."""
    clean = without_noise(F.col("text"))
    kept = F.when(clean == "", 0).otherwise(F.size(F.split(clean, "\n")))
    return pages.withColumn("clean_text", clean).withColumn(
        "removed_lines", F.size(_lines(F.col("text"))) - kept
    )


def is_corrupted(text: Column) -> Column:
    bad = F.length(text) - F.length(F.translate(text, BAD_GLYPHS, ""))
    letters_only = F.regexp_replace(text, r"[^\p{L}]", "")
    letters = F.length(letters_only)
    vowels = letters - F.length(F.translate(letters_only, VOWELS, ""))
    glyphs = (bad >= MIN_BAD) & (bad / F.length(text) >= MIN_BAD_SHARE)
    consonants = (letters >= MIN_LETTERS) & (vowels / letters < MIN_VOWEL_SHARE)
    return F.coalesce((F.length(text) >= MIN_AUDITED) & (glyphs | consonants), F.lit(False))


def encoding_audit(pages: DataFrame, key: str) -> DataFrame:
    bad = F.count_if(is_corrupted(F.col("text")))
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"),
        bad.alias("corrupted_pages"),
        F.round(bad / F.count(F.lit(1)), 4).alias("corrupted_share"),
    )


def digital_text(text: Column) -> Column:
    """Page text if it can be used as it is, else null."""
    joined = F.array_join(_lines(text), "\n")
    return F.when((F.length(joined) >= MIN_PAGE_CHARS) & ~is_corrupted(joined), joined)


def scanned_documents(pages: DataFrame, key: str) -> DataFrame:
    digital = F.count(digital_text(F.col("text")))
    total = F.count(F.lit(1))
    return pages.groupBy(key).agg(
        total.alias("pages"),
        digital.alias("digital_pages"),
        (digital < total * SCAN_SHARE).alias("is_scan"),
    )


def samples(pages: DataFrame) -> DataFrame:
    """First six and last three pages of each source, each cut short; at most nine rows meet."""
    last = pages.groupBy("source_id").agg(F.max("page_number").alias("_last"))
    back = F.greatest(F.lit(FRONT_PAGES + 1), F.col("_last") - (BACK_PAGES - 1))
    chosen = (
        pages.join(last, "source_id")
        .where((F.col("page_number") <= FRONT_PAGES) | (F.col("page_number") >= back))
        .where(F.col("text").isNotNull())
    )
    cut = F.substring("text", 1, SAMPLE_CHARS)
    parts = F.sort_array(F.collect_list(F.struct("page_number", cut.alias("cut"))))
    return chosen.groupBy("source_id").agg(
        F.array_join(F.transform(parts, lambda p: F.concat(p["cut"], F.lit("\n"))), "").alias(
            "sample_text"
        )
    )


# Subjects in order of trial - code, name, domain, phrases and pattern of the file
# name, phrases of the text.
LANGUAGE = "b581ee4c-7277-4be8-a156-c5b20a0a59f6"
NATURAL = "77777777-7777-7777-7777-000000000001"
SOCIAL = "77777777-7777-7777-7777-000000000002"
MATHS = "6f3765db-943e-4810-bf74-d6a8bdc215da"
SUBJECT_RULES = [
    (
        "VIET", "Ngữ văn / Tiếng Việt", LANGUAGE,
        ["ngữ văn", "ngu van", "ngu-van", "nguvan", "tiếng việt", "văn "],
        r"\b(nv|van)[_\-\s.]",
        "ngữ văn|thơ trữ tình|truyện ngắn|nghị luận xã hội|nghị luận văn học|thần thoại|sử thi"
        "|hài kịch|bi kịch|tùy bút|tản văn|phóng sự|văn tế|tri thức ngữ văn",
    ),
    (
        "ENGL", "Tiếng Anh", LANGUAGE,
        ["tiếng anh", "english", "friends global", "global success"],
        r"\b(eng|ta)[_\-\s.]",
        "reading comprehension|grammar|vocabulary|phrasal verbs|relative clauses|passive voice",
    ),
    (
        "PHYS", "Vật lí", NATURAL,
        ["vật lí", "vật lý", "vat li", "vat ly", "physics"],
        r"\bvl\b|[_\-\s]vl[_\-\s.]|\bsgk\s*vl\b",
        "vật lí|vật lý|dao động điều hòa|sóng cơ|điện trường|từ trường|cảm ứng điện từ"
        "|khí lí tưởng|vật lí nhiệt|vật lí hạt nhân|định luật newton|động lượng",
    ),
    (
        "CHEM", "Hóa học", NATURAL,
        ["hóa học", "hoá học", "hoa hoc", "chemistry", "ester"],
        r"\b(hh|hoa|hóa|hoá)[_\-\s.]|\bsgk\s*hh\b",
        "hóa học|hoá học|ester|lipid|carbohydrate|glucose|amine|amino acid|peptide|polymer"
        "|điện phân|pin galvani|enthalpy|cân bằng hóa học|cân bằng hoá học|hydrocarbon",
    ),
    (
        "BIO", "Sinh học", NATURAL,
        ["sinh học", "sinh hoc", "biology"],
        r"\b(sh|sinh)[_\-\s.]|\bsgk\s*sh\b",
        "sinh học|phiên mã|dịch mã|nhiễm sắc thể|di truyền|quần thể|quần xã|hệ sinh thái"
        "|tiến hóa|nguyên phân|giảm phân",
    ),
    (
        "HIST", "Lịch sử", SOCIAL,
        ["lịch sử", "lich su", "history"],
        r"\b(ls|su)[_\-\s.]|\bsgk\s*ls\b",
        "lịch sử|chiến tranh lạnh|cách mạng tháng tám|kháng chiến chống pháp"
        "|kháng chiến chống mỹ|công cuộc đổi mới",
    ),
    (
        "GEO", "Địa lí", SOCIAL,
        ["địa lí", "địa lý", "dia li", "geography"],
        r"\b(dl|dia)[_\-\s.]|\bsgk\s*dl\b",
        "địa lí|địa lý|nhiệt đới ẩm gió mùa|đô thị hóa|vùng kinh tế|đồng bằng sông cửu long"
        "|đông nam bộ",
    ),
    (
        "LOGIC_DATA", "Tư duy Logic & Phân tích số liệu", MATHS,
        ["logic", "số liệu"],
        None,
        "tư duy logic|phân tích số liệu|xếp vị trí bàn tròn",
    ),
]
# Subjects by words of the domain hint, the default, names by code.
HINT_RULES = [
    ("VIET", "Ngữ văn / Tiếng Việt", LANGUAGE, ["b581ee4c", "lang", "ngôn ngữ", "văn"]),
    ("PHYS", "Khoa học tự nhiên", NATURAL, [NATURAL, "khtn", "natural"]),
    ("HIST", "Khoa học xã hội", SOCIAL, [SOCIAL, "khxh", "social"]),
]
DEFAULT_SUBJECT = ("MATH", "Toán học", MATHS)
SUBJECT_NAMES = {code: name for code, name, *_ in SUBJECT_RULES} | {
    "OUT_OF_SCOPE_DGNL": "Kiến thức ngoài phạm vi ĐGNL"
}
GIVEN_DOMAINS = {
    "VIET": LANGUAGE, "ENGL": LANGUAGE, "PHYS": NATURAL, "CHEM": NATURAL, "BIO": NATURAL,
    "HIST": SOCIAL, "GEO": SOCIAL,
}
# Grades by name, in order of trial, then by topic.
GRADE_NAMES = (
    r"\b(lớp\s*{n}|toán\s*{n}|ngữ\s*văn\s*{n}|vật\s*l[íý]\s*{n}|h[óo][aá]\s*học\s*{n}"
    r"|h[óo][aá]\s*{n}|sinh\s*học\s*{n}|lịch\s*sử\s*{n}|địa\s*l[íý]\s*{n}|khối\s*{n}|grade\s*{n}"
    r"|[_\-\s]{n}[_\-\s.])\b"
)
GRADE_TOPICS = [
    (
        12,
        "nguyên hàm|tích phân|tiệm cận|mặt cầu|xác suất có điều kiện|công thức bayes|ester"
        "|carbohydrate|vật lí nhiệt|khí lí tưởng|vật lí hạt nhân",
    ),
    (
        11,
        "cấp số cộng|cấp số nhân|hàm số liên tục|lôgarit|quan hệ song song|quan hệ vuông góc"
        "|dao động điều hòa|sóng dừng|cân bằng hóa học|cân bằng hoá học|hydrocarbon",
    ),
    (
        10,
        "mệnh đề và tập hợp|tam thức bậc hai|nhị thức newton|ba đường conic|thần thoại|sử thi"
        "|cấu tạo nguyên tử|phản ứng oxi hóa|phản ứng oxi hoá|tốc độ phản ứng",
    ),
]
DEFAULT_GRADE = 12
# Book editions in order of trial.
EDITIONS = [
    ("Kết nối tri thức với cuộc sống", ["kết nối tri thức", "ket noi tri thuc", "kntt"], None),
    ("Cánh diều", ["cánh diều", "canh dieu"], r"\bcd\b|[_\-\s]cd[_\-\s.]"),
]
DEFAULT_EDITION = "Chân trời sáng tạo"


def _first(rules: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def detect_grade(lower_text: Column, ascii_words: bool = False) -> Column:
    rules = [
        (lower_text.rlike(words_of(GRADE_NAMES.format(n=n), ascii_words)), n) for n in (10, 11, 12)
    ] + [(lower_text.rlike(words_of(rf"\b({topics})\b", ascii_words)), n) for n, topics in GRADE_TOPICS]
    return _first(rules, DEFAULT_GRADE)


def detect_edition(lower_text: Column, ascii_words: bool = False) -> Column:
    rules = []
    for name, phrases, pattern in EDITIONS:
        hit = contains_any(lower_text, phrases)
        rules.append((hit | lower_text.rlike(words_of(pattern, ascii_words)) if pattern else hit, name))
    return _first(rules, DEFAULT_EDITION)


def identify(
    documents: DataFrame, out_of_scope: list[str], ascii_words: bool = False
) -> DataFrame:
    """Subject, domain, grade and edition from file name, sample text and hints.

    ``documents``: file_name, sample_text and, where known, hint_domain, hint_subject, hint_grade,
    hint_edition. ``out_of_scope``: keywords that rule a document out.
    ``ascii_words``: words end where ASCII letters, digits and _ do, as in SQL on DuckDB.
    """
    have = documents.columns

    def hint(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    rows = documents.withColumns(
        {
            "_name": F.lower(F.coalesce("file_name", F.lit(""))),
            "_all": F.lower(
                F.concat(
                    F.coalesce("file_name", F.lit("")), F.lit("\n"),
                    F.coalesce("sample_text", F.lit("")),
                )
            ),
            "_hint": F.lower(F.coalesce(hint("hint_domain"), F.lit(""))),
            "_given": F.upper(F.trim(F.coalesce(hint("hint_subject"), F.lit("")))),
        }
    )
    name, text, given = F.col("_name"), F.col("_all"), F.col("_given")
    banned = _first([(F.contains(text, F.lit(w.lower())), w.lower()) for w in out_of_scope], None)
    is_given = ~given.isin("", "AUTO")
    cascade = []
    for code, title, domain, phrases, pattern, topics in SUBJECT_RULES:
        hit = contains_any(name, phrases) | text.rlike(words_of(rf"\b({topics})\b", ascii_words))
        if pattern:
            hit = hit | name.rlike(words_of(pattern, ascii_words))
        cascade.append((hit, (code, title, domain)))
    for code, title, domain, phrases in HINT_RULES:
        cascade.append((contains_any(F.col("_hint"), phrases), (code, title, domain)))

    def found(part: int) -> Column:
        return _first([(c, values[part]) for c, values in cascade], DEFAULT_SUBJECT[part])

    given_name = _first([(given == c, n) for c, n in SUBJECT_NAMES.items()], DEFAULT_SUBJECT[1])
    given_domain = _first([(given == c, v) for c, v in GIVEN_DOMAINS.items()], MATHS)
    out = F.col("_banned").isNotNull()
    asked_grade = F.when(hint("hint_grade", "int") > 0, hint("hint_grade", "int"))
    asked_edition = F.when(~is_blank(hint("hint_edition")), hint("hint_edition"))
    detected = detect_grade(text, ascii_words)
    return (
        rows.withColumn("_banned", banned)
        .withColumns(
            {
                "subject_code": F.when(out, "OUT_OF_SCOPE_DGNL").when(is_given, given).otherwise(
                    found(0)
                ),
                "subject_name": F.when(
                    out, F.concat(F.lit("Kiến thức ngoài ĐGNL ("), "_banned", F.lit(")"))
                )
                .when(is_given, given_name)
                .otherwise(found(1)),
                "domain_id": F.when(out, "OUT_OF_SCOPE").when(is_given, given_domain).otherwise(
                    found(2)
                ),
                "grade": F.when(out, detected).otherwise(F.coalesce(asked_grade, detected)),
                "book_edition": F.when(out, "GDPT 2018").otherwise(
                    F.coalesce(asked_edition, detect_edition(text, ascii_words))
                ),
                "is_in_scope": ~out,
            }
        )
        .drop("_name", "_all", "_hint", "_given", "_banned")
    )


# Tags, imprint lines, header lines and section words.
TAG = r"(?i)\[TAXONOMY\s*:\s*([^\]]+)\]"
IMPRINT_LINE = (
    r"(?ium)^[ \t]*(?:Tên sách|Bộ sách|Tổng chủ biên|Chủ biên|Các tác giả|Nhà xuất bản"
    r"|Chịu trách nhiệm xuất bản|Mã số sách|Giấy phép xuất bản|In tại)\s*:.*$"
)
LESSON_END_NOTE = r"(?iu)\(Trang\s+\d+\s+là\s+trang\s+kết\s+thúc\s+bài\s+học[^)]*\)"
IMPRINT_WORDS = (
    "tổng chủ biên|chủ biên|nhà xuất bản|chịu trách nhiệm xuất bản|trình bày bìa|mã số sách"
)
COVER_WORDS = (
    IMPRINT_WORDS
    + "|giấy phép xuất bản|lời nói đầu|hướng dẫn sử dụng sách|bìa 1|bìa 4|mục lục|table of contents"
)
COVER_PLACE = ("Thông tin xuất bản", "Bìa & Bản quyền", "Thông tin xuất bản")
CHAPTER_LINE = (
    r"(?ium)^(?:#+\s*)?(Chương\s+(?:[IVXLC]+|\d+)\s*[:.\-–]\s*[^\r\n]{3,90}"
    r"|Chuyên\s+đề\s+\d+\s*[:.\-–]\s*[^\r\n]{3,90})"
)
LESSON_LINE = r"(?ium)^(?:#+\s*)?(Bài\s+\d+\s*[:.\-–]\s*[^\r\n]{3,100})"
PATTERN_LINE = r"(?ium)^(?:#+\s*|\*\*)?(Dạng\s+\d+\s*[:.\-–]\s*[^\r\n*]{3,110})"
SECTIONS = ["THEORY", "FORMULA", "EXAMPLE", "EXERCISE", "PASSAGE", "COVER"]
EXERCISE_WORDS = r"(?sU)\b(bài tập cuối|luyện tập\s+\d+|câu\s+1[.:]\s+.*câu\s+2[.:])"
EXAMPLE_WORDS = r"(?U)\b(ví dụ\s+\d+|bài toán mẫu|lời giải|hướng dẫn giải)\b"
FORMULA_WORDS = r"(?U)\b(định lí|công thức|tính chất|hệ quả)\b"
FORMULA_DOLLARS, PASSAGE_CHARS = 8, 1200
# Subject codes by words of a tag, in order of trial.
TAG_SUBJECTS = [
    ("MATH", ["MATH", "TOÁN", "TOAN"]),
    ("VIET", ["VIET", "LIT", "VĂN", "VAN"]),
    ("ENGL", ["ENG", "ANH"]),
    ("PHYS", ["PHYS", "LÍ", "LÝ", "LI"]),
    ("CHEM", ["CHEM", "HÓA", "HOA"]),
    ("BIO", ["BIO", "SINH"]),
    ("HIST", ["HIST", "SỬ", "SU"]),
    ("GEO", ["GEO", "ĐỊA", "DIA"]),
    ("LOGIC_DATA", ["LOGIC", "DATA"]),
]


def attribute(block: Column, key: str) -> Column:
    """Value of key="v", key='v' or key=v in a tag, else null."""
    double = F.regexp_extract(block, rf"""(?iU)\b{key}\s*=\s*"([^"]+)\"""", 1)
    single = F.regexp_extract(block, rf"(?iU)\b{key}\s*=\s*'([^']+)'", 1)
    bare = F.regexp_extract(block, rf"(?iU)\b{key}\s*=\s*([^|\]]+)", 1)
    return (
        F.when(double != "", strip(double))
        .when(single != "", strip(single))
        .when(bare != "", F.regexp_replace(strip(bare), r"""^["']+|["']+$""", ""))
    )


def _last_value(tags: Column, key: str) -> Column:
    values = F.filter(
        F.transform(tags, lambda t: attribute(t, key)),
        lambda v: v.isNotNull() & (v != "") & (F.lower(v) != "unknown"),
    )
    return F.get(values, F.size(values) - 1)


def _header(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", F.regexp_replace(strip(found), r"^\*+|\*+$", ""))


def read_structure(pages: DataFrame) -> DataFrame:
    """What each page itself says: clean text, tagged subject, grade and section, and the chapter,
    lesson and pattern that a tag, an imprint page or a header line puts it under.
    """
    tags = F.regexp_extract_all("text", F.lit(TAG), F.lit(1))
    subject = F.upper(_last_value(tags, "subject"))
    bare = strip(F.regexp_replace("text", r"(?i)\[TAXONOMY\s*:[^\]]+\]", ""))
    clean = F.regexp_replace(F.regexp_replace(bare, IMPRINT_LINE, ""), LESSON_END_NOTE, "")
    lower = F.lower(F.col("clean_text"))
    imprint = lower.rlike(rf"(?U)\b({IMPRINT_WORDS})\b") & ~contains_any(
        lower, ["định nghĩa", "công thức"]
    )
    rows = pages.withColumns(
        {
            "_tags": tags,
            "clean_text": clean,
            "tag_subject": _first(
                [(contains_any(subject, words), code) for code, words in TAG_SUBJECTS], None
            ),
            "tag_grade": F.regexp_extract(
                F.coalesce(_last_value(tags, "grade"), F.lit("")), "1[0-2]", 0
            ).try_cast("int"),
            "_section": _last_value(tags, "section"),
        }
    ).withColumn("_imprint", imprint)
    text = F.col("clean_text")
    places = {}
    for name, pattern, cover in zip(
        ("chapter", "lesson", "pattern"), (CHAPTER_LINE, LESSON_LINE, PATTERN_LINE), COVER_PLACE
    ):
        places[f"own_{name}"] = F.coalesce(
            _header(text, pattern),
            F.when(F.col("_imprint"), cover),
            _last_value(F.col("_tags"), name),
        )
    return rows.withColumns(places).withColumn(
        "explicit_section", F.when(F.col("_imprint"), "COVER").otherwise(F.col("_section"))
    ).drop("_tags", "_imprint", "_section")


def section_type(text: Column, explicit: Column, subject: Column) -> Column:
    lower = F.lower(text)
    told = F.upper(strip(F.coalesce(explicit, F.lit(""))))
    dollars = F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))
    return (
        F.when(told.isin(*SECTIONS), told)
        .when(
            lower.rlike(rf"(?U)\b({COVER_WORDS})\b")
            | (F.contains(lower, F.lit("tên sách:")) & F.contains(lower, F.lit("bộ sách:"))),
            "COVER",
        )
        .when(lower.rlike(EXERCISE_WORDS), "EXERCISE")
        .when(lower.rlike(EXAMPLE_WORDS), "EXAMPLE")
        .when(
            (subject == "VIET")
            & (F.contains(lower, F.lit("văn bản")) | (F.length(text) > PASSAGE_CHARS)),
            "PASSAGE",
        )
        .when((dollars >= FORMULA_DOLLARS) & lower.rlike(FORMULA_WORDS), "FORMULA")
        .otherwise("THEORY")
    )


# Diagrams - tags, captions, types by words, in order of trial.
DIAGRAM_TAG = r"(?i)\[IMAGE_PLACEHOLDER\s*:\s*([^\]]+)\]"
CAPTION = r"(?ium)^[ \t]*(?:\*\*)?(Hình\s+\d+[.\d]*\s*[:.\-–]\s*[^\r\n]{4,120})(?:\*\*)?$"
DIAGRAM_WORDS = [
    ("VARIATION_TABLE", ["bảng biến thiên", "variation"]),
    ("GRAPH_2D", ["đồ thị", "parabol", "tiệm cận", "graph_2d"]),
    ("GEOMETRY_3D", ["hình chóp", "tứ diện", "lăng trụ", "mặt cầu", "oxyz", "3d"]),
    ("LAB_DIAGRAM", ["thí nghiệm", "mạch điện", "sơ đồ"]),
    ("CHART", ["biểu đồ", "lược đồ", "bản đồ"]),
]
LAB_SUBJECTS = ["CHEM", "PHYS", "BIO"]


def diagram_type(description: Column, subject: Column) -> Column:
    lower = F.lower(description)
    rules = []
    for kind, words in DIAGRAM_WORDS:
        hit = contains_any(lower, words)
        rules.append((hit | subject.isin(*LAB_SUBJECTS) if kind == "LAB_DIAGRAM" else hit, kind))
    return _first(rules, "FIGURE")


def placeholders(pages: DataFrame) -> DataFrame:
    """Adds ``placeholders`` (array of id, page_number, diagram_type, description) to pages with
    clean_text and subject_code, and writes them into the text: tags in one form, and where a page
    has only captions, a tag below each caption.
    """
    text, subject = F.col("clean_text"), F.col("subject_code")
    number = F.col("page_number").cast("string")

    def item(attrs: Column, i: Column, tagged: bool) -> Column:
        fallback = F.concat(F.lit("img_p"), number, F.lit("_"), (i + 1).cast("string"))
        if tagged:
            name = F.coalesce(attribute(attrs, "id"), fallback)
            kind = F.upper(F.coalesce(attribute(attrs, "type"), diagram_type(attrs, subject)))
            told = F.coalesce(attribute(attrs, "desc"), attribute(attrs, "description"), strip(attrs))
        else:
            name, kind, told = fallback, diagram_type(attrs, subject), attrs
        return F.struct(
            name.alias("id"),
            F.col("page_number").alias("page_number"),
            kind.alias("diagram_type"),
            strip(F.replace(strip(told), F.lit('"'), F.lit("'"))).alias("description"),
        )

    tags = F.regexp_extract_all(text, F.lit(DIAGRAM_TAG), F.lit(1))
    captions = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(1))
    has_tags = F.size(tags) > 0
    rows = pages.withColumn(
        "placeholders",
        F.when(has_tags, F.transform(tags, lambda a, i: item(a, i, True))).otherwise(
            F.transform(captions, lambda a, i: item(a, i, False))
        ),
    )

    def written(p: Column) -> Column:
        return F.concat(
            F.lit('[IMAGE_PLACEHOLDER: id="'), p["id"],
            F.lit('" page="'), p["page_number"].cast("string"),
            F.lit('" type="'), p["diagram_type"], F.lit('" desc="'), p["description"], F.lit('"]'),
        )

    found = F.col("placeholders")
    around_tags = F.zip_with(
        F.split(text, DIAGRAM_TAG), found,
        lambda t, p: F.concat(t, F.coalesce(written(p), F.lit(""))),
    )
    whole = F.regexp_extract_all(text, F.lit(CAPTION), F.lit(0))
    below = F.zip_with(
        whole, found, lambda c, p: F.concat(c, F.lit("\n"), written(p), F.lit("\n"))
    )
    around_captions = F.zip_with(
        F.split(text, CAPTION), below, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))
    )
    rewritten = (
        F.when(F.size(found) == 0, text)
        .when(has_tags, F.array_join(around_tags, ""))
        .otherwise(F.array_join(around_captions, ""))
    )
    return rows.withColumn("page_text", rewritten)


# Weights of a page against a taxonomy node, and words that are no keywords.
LESSON_HIT, CHAPTER_HIT, KEYWORD_HIT, GRADE_HIT, MIN_HIT = 8, 5, 2, 2, 5
MIN_PHRASE, MIN_KEYWORD = 5, 4
COMMON_WORDS = ["dạng", "trong", "hoặc", "bằng", "biết", "tính", "hàm", "phần"]
KEYWORD_SEPARATORS = r"[ ,.;:()\-/\\]+"
ANY_OTHER_GRADE = -1


def node_phrases(nodes: DataFrame) -> DataFrame:
    """Nodes with the phrases and keywords that a page is searched for."""
    chapter = F.regexp_replace(F.lower("chapter_name"), r"(?u)^chương\s*\d+\s*:\s*", "")
    lesson = F.regexp_replace(F.lower("lesson_name"), r"(?u)^bài\s*[\d,\s&]+\s*:\s*", "")
    pattern = F.regexp_replace(F.lower("pattern_name"), r"(?u)^dạng\s*\d+\s*:\s*", "")
    words = F.split(F.concat_ws(" ", lesson, pattern), KEYWORD_SEPARATORS)
    keywords = F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= MIN_KEYWORD) & ~w.isin(*COMMON_WORDS))
    )
    return nodes.select(
        "ord", "subject_code", "grade",
        F.when(F.length(chapter) >= MIN_PHRASE, chapter).otherwise("").alias("chapter"),
        F.when(F.length(lesson) >= MIN_PHRASE, lesson).otherwise("").alias("lesson"),
        keywords.alias("keywords"),
    )


def _found_in(texts: pd.Series, phrases: list[str]) -> np.ndarray:
    from gradus.operators.retrieval import _word_hits

    return _word_hits(texts, phrases)


def _match_pages(
    batch: pd.DataFrame, held: pd.DataFrame, all_grades: list[int]
) -> pd.DataFrame:
    nodes = held.sort_values("ord", kind="stable").reset_index(drop=True)
    phrases = sorted(
        {p for p in [*nodes["chapter"], *nodes["lesson"]] if p}
        | {w for ws in nodes["keywords"] for w in ws}
    )
    place = {p: i for i, p in enumerate(phrases)}
    weights = np.zeros((len(phrases), len(nodes)))
    for j, node in enumerate(nodes.itertuples(index=False)):
        if node.lesson:
            weights[place[node.lesson], j] += LESSON_HIT
        if node.chapter:
            weights[place[node.chapter], j] += CHAPTER_HIT
        for word in node.keywords:
            weights[place[word], j] += KEYWORD_HIT
    subjects = nodes["subject_code"].str.lower().to_numpy()[None, :]
    grades, ords = nodes["grade"].to_numpy(), nodes["ord"].to_numpy()
    parts = []
    for part in slices(batch, max(len(phrases), len(nodes))):
        base = _found_in(part["_text"], phrases) @ weights
        base[part["subject_code"].str.lower().to_numpy()[:, None] != subjects] = -np.inf
        for running in [ANY_OTHER_GRADE, *all_grades]:
            score = base + GRADE_HIT * (grades == running)
            best = np.argmax(score, axis=1)
            value = score[np.arange(len(part)), best]
            good = value >= MIN_HIT
            parts.append(
                pd.DataFrame(
                    {
                        "_page": part["_page"].to_numpy()[good],
                        "running_grade": running,
                        "ord": ords[best[good]],
                        "score": value[good].astype(int),
                    }
                )
            )
    return pd.concat(parts, ignore_index=True)


def match_nodes(pages: DataFrame, nodes: DataFrame, **limits: int) -> DataFrame:
    """Best node of the page's subject for every grade that may be running when it is read.

    ``pages``: _page (key), clean_text, subject_code. Rows (_page, running_grade, ord, score); grade
    -1 stands for any grade without nodes. Pages without a match are left out.
    """
    p = pages.select("_page", "subject_code", F.lower("clean_text").alias("_text"))
    n = node_phrases(nodes)
    types = [df.schema[c].dataType.simpleString() for df, c in ((p, "_page"), (n, "ord"))]
    schema = f"_page {types[0]}, running_grade int, ord {types[1]}, score int"
    width = (F.length("chapter") + F.length("lesson") + F.size("keywords") * 60) * 4 + 100
    all_grades = sorted(r[0] for r in nodes.select("grade").distinct().collect())

    def match(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _match_pages(batch, held, all_grades)

    found, complete = score_blocks(
        p, n, "_page", "ord", match, schema, width, **(NODE_LIMITS | limits)
    )
    if complete:
        return found
    best = found.groupBy("_page", "running_grade").agg(
        F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("_b")
    )
    return best.select("_page", "running_grade", "_b.*")


PAGES_PER_BUCKET = 512
BUCKETS_PER_GROUP = 512


def _grouped(ends: DataFrame) -> DataFrame:
    """(source_id, _group, _start, _chain): the grade functions of a group's buckets, in order."""
    return ends.groupBy(
        "source_id", F.floor(F.col("_bucket") / BUCKETS_PER_GROUP).cast("bigint").alias("_group")
    ).agg(
        F.min("_start").alias("_start"),
        F.sort_array(
            F.collect_list(F.struct("_bucket", F.map_entries("_ends").alias("_ends")))
        ).alias("_chain"),
    )


def _composed(groups: DataFrame) -> DataFrame:
    """(source_id, _bucket, _start, _ends): each group as one function, where it takes every grade."""
    grades = F.transform(F.col("_chain")[0]["_ends"], lambda e: e["key"])
    through = F.transform(
        grades,
        lambda g: F.aggregate(
            "_chain", g, lambda at, b: F.element_at(F.map_from_entries(b["_ends"]), at)
        ),
    )
    return groups.select(
        "source_id", F.col("_group").alias("_bucket"), "_start", F.map_from_arrays(grades, through).alias("_ends")
    )


def _handed_down(groups: DataFrame) -> DataFrame:
    """(source_id, _bucket, _grade): the grade that each bucket of a group starts with, from the
    ``_grade`` that the group starts with."""
    empty = F.array().cast("array<struct<_bucket:bigint,_grade:int>>")
    starts = F.aggregate(
        "_chain",
        F.struct(F.col("_grade").alias("grade"), empty.alias("starts")),
        lambda acc, b: F.struct(
            F.element_at(F.map_from_entries(b["_ends"]), acc["grade"]).alias("grade"),
            F.concat(
                acc["starts"],
                F.array(F.struct(b["_bucket"].alias("_bucket"), acc["grade"].alias("_grade"))),
            ).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    return groups.select("source_id", starts.alias("_starts")).select("source_id", F.inline("_starts"))


def running_grades(steps: DataFrame, bucket_pages: int = PAGES_PER_BUCKET) -> DataFrame:
    """The grade in force on each page, where a match may change it for the pages after.

    ``steps``: source_id, page_number, start_grade, tag_grade, moves (map of running grade to the
    grade a match leaves; -1 for grades not listed). A page is a function from grade to grade, and
    a run of pages is again one. So each bucket of pages is reduced to where it takes every grade
    that can occur, buckets to groups and groups to groups of groups in the same way, so that no row
    holds more than a group's functions however many pages a source has. The grades they start with
    are handed down again, and the pages of a bucket are walked from its own. Returns (source_id, page_number, grade_read, grade).
    """

    def read(grade: Column, page: Column) -> Column:
        return F.coalesce(page["tag_grade"], grade)

    def move(grade: Column, page: Column) -> Column:
        known = F.map_contains_key(page["moves"], grade)
        key = F.when(known, grade).otherwise(F.lit(ANY_OTHER_GRADE))
        return F.coalesce(F.try_element_at(page["moves"], key), grade)

    rows = steps.withColumn("_bucket", bucket_of(F.col("page_number"), bucket_pages))
    buckets = rows.groupBy("source_id", "_bucket").agg(
        F.sort_array(
            F.collect_list(F.struct("page_number", "tag_grade", F.map_entries("moves").alias("m")))
        ).alias("_raw"),
    )
    buckets = buckets.select(
        "source_id",
        "_bucket",
        F.transform(
            "_raw",
            lambda p: F.struct(
                p["page_number"].alias("page_number"),
                p["tag_grade"].alias("tag_grade"),
                F.map_from_entries(p["m"]).alias("moves"),
            ),
        ).alias("_pages"),
    )
    reachable = rows.groupBy("source_id").agg(
        F.array_union(
            F.array_union(
                F.collect_set("start_grade"), F.collect_set("tag_grade")
            ),
            F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.map_values("moves"))))),
        ).alias("_grades"),
        F.min("start_grade").alias("_start"),
    )

    def walk(grade: Column, pages: Column) -> Column:
        return F.aggregate(pages, grade, lambda g, p: move(read(g, p), p))

    ends = buckets.join(reachable, "source_id").select(
        "source_id",
        "_bucket",
        "_start",
        F.map_from_arrays(
            "_grades", F.transform("_grades", lambda g: walk(g, F.col("_pages")))
        ).alias("_ends"),
    )
    # Buckets in groups, groups in groups of groups: page numbers are ints, so the third level is one row.
    first = _grouped(ends)
    second = _grouped(_composed(first))
    third = _grouped(_composed(second))
    starts = _handed_down(third.withColumn("_grade", F.col("_start")))
    for level in (second, first):
        above = starts.withColumnRenamed("_bucket", "_group")
        starts = _handed_down(level.join(above, ["source_id", "_group"]))
    none = F.array().cast("array<struct<page_number:int,grade_read:int,grade:int>>")
    walked = buckets.join(starts, ["source_id", "_bucket"]).select(
        "source_id",
        F.aggregate(
            "_pages",
            F.struct(F.col("_grade").alias("grade"), none.alias("out")),
            lambda acc, p: F.struct(
                move(read(acc["grade"], p), p).alias("grade"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            p["page_number"].alias("page_number"),
                            read(acc["grade"], p).alias("grade_read"),
                            move(read(acc["grade"], p), p).alias("grade"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        ).alias("_out"),
    )
    return walked.select("source_id", F.inline("_out"))


def _told_subjects(pages: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(told, texts): what is read from each page with the subject in force on it, and its clean text."""
    at = ["source_id", "page_number"]
    read = read_structure(pages)
    own = (
        read.drop(*[c for c in pages.columns if c not in at], "clean_text")
        .join(sources.select("source_id", "subject_code", "grade", "book_edition"), "source_id")
        .withColumnsRenamed({"subject_code": "_subject", "grade": "start_grade"})
    )
    told = carry_last(
        own, ["source_id"], ["page_number"], bucket_of(F.col("page_number")), {"_told_subject": F.col("tag_subject")}
    ).select("*", F.coalesce("_told_subject", "_subject").alias("subject_code"))
    return told, read.select(*at, "clean_text")


def page_diagrams(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, page_number, id, diagram_type, description) of the diagrams of ``classify_pages``, which
    need the subject in force alone: no page is matched with the taxonomy."""
    told, texts = _told_subjects(pages, sources)
    at = ["source_id", "page_number"]
    drawn = placeholders(told.select(*at, "subject_code").join(texts, at))
    return drawn.select("source_id", F.explode("placeholders").alias("p")).select(
        "source_id", "p.page_number", "p.id", "p.diagram_type", "p.description"
    )


def classify_pages(pages: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each page with the subject, grade, chapter, lesson and pattern in force on it, its section
    type, its diagrams and its final text.

    ``page_number`` is an int, unique in a source. Tags, headers and matches with the taxonomy
    overwrite what is carried; the first page without a match while chapter or lesson are still
    open takes the first node of its subject and grade. Texts stay out of the windows: they are
    joined in where a page is matched, and at the end.
    """
    at = ["source_id", "page_number"]
    bucket = bucket_of(F.col("page_number"))
    told, texts = _told_subjects(pages, sources)
    told = told.withColumn("_page", F.concat_ws("#", *at))

    found = match_nodes(texts.join(told.select(*at, "_page", "subject_code"), at), nodes)
    node_grades = nodes.select("ord", F.col("grade").alias("_node_grade"))
    moves = (
        found.join(node_grades, "ord")
        .groupBy("_page")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("running_grade", "_node_grade"))).alias("moves"),
            F.map_from_entries(F.collect_list(F.struct("running_grade", "ord"))).alias("_ords"),
        )
    )
    listed = nodes.agg(F.collect_set("grade").alias("g")).first()["g"]
    rows = checkpointed(told.join(moves, "_page", "left").withColumns(
        {
            c: F.coalesce(c, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast(t)))
            for c, t in (("moves", "array<int>"), ("_ords", f"array<{nodes.schema['ord'].dataType.simpleString()}>"))
        }
    ))
    full = [ANY_OTHER_GRADE, *sorted(listed)]
    every = F.map_from_arrays(
        F.array(*[F.lit(g) for g in full]),
        F.array(*[F.try_element_at("moves", F.lit(g)) for g in full]),
    )
    grades = running_grades(
        rows.select("source_id", "page_number", "start_grade", "tag_grade", every.alias("moves"))
    )
    running = F.when(F.col("grade_read").isin(*listed), F.col("grade_read")).otherwise(ANY_OTHER_GRADE)
    names = nodes.select(
        F.col("ord").alias("_ord"),
        *[F.when(F.col(f"{c}_name") != "", F.col(f"{c}_name")).alias(f"_node_{c}") for c in ("chapter", "lesson", "pattern")],
    )
    matched = (
        rows.join(grades, ["source_id", "page_number"])
        .withColumn("_ord", F.try_element_at("_ords", running))
        .join(names, "_ord", "left")
    )
    parts = ("chapter", "lesson", "pattern")
    carried = checkpointed(carry_last(
        checkpointed(matched).withColumns({f"_set_{c}": F.coalesce(f"_node_{c}", f"own_{c}") for c in parts}),
        ["source_id"],
        ["page_number"],
        bucket,
        {f"_run_{c}": F.col(f"_set_{c}") for c in parts},
    ))
    subjects = nodes.groupBy("subject_code").agg(F.min("ord").alias("_any"))
    by_grade = nodes.groupBy("subject_code", "grade").agg(F.min("ord").alias("_exact"))
    open_pages = (
        carried.where("_ord is null and (_run_chapter is null or _run_lesson is null)")
        .join(subjects, "subject_code")
        .groupBy("source_id")
        .agg(F.min(F.struct("page_number", "subject_code", "grade", "_any")).alias("_d"))
        .select("source_id", F.col("_d.page_number").alias("_from"), "_d.subject_code", "_d.grade", "_d._any")
    )
    defaults = (
        open_pages.join(by_grade, ["subject_code", "grade"], "left")
        .withColumn("_ord", F.coalesce("_exact", "_any"))
        .join(names, "_ord")
        .select("source_id", "_from", *[F.col(f"_node_{c}").alias(f"_default_{c}") for c in parts])
    )
    placed = carried.join(defaults, "source_id", "left")
    subject_name = _first(
        [(F.col("subject_code") == c, n) for c, n in SUBJECT_NAMES.items()], DEFAULT_SUBJECT[1]
    )
    fallback = {
        "chapter": F.concat_ws(" ", F.lit("Chương trọng tâm"), "subject_name", "grade"),
        "lesson": F.lit("Bài 1: Nội dung cốt lõi SGK"),
        "pattern": F.lit("Dạng 1: Kiến thức & Kỹ năng trọng tâm"),
    }
    late = F.col("page_number") >= F.col("_from")
    out = placeholders(placed.withColumn("subject_name", subject_name).join(texts, at))
    text = F.col("page_text")
    return out.select(
        "source_id",
        "page_number",
        text.alias("text"),
        F.length(text).alias("char_count"),
        "subject_code",
        "subject_name",
        "grade",
        "book_edition",
        *[
            F.coalesce(F.col(f"_run_{c}"), F.when(late, F.col(f"_default_{c}")), fallback[c]).alias(
                f"{c}_name"
            )
            for c in parts
        ],
        section_type(text, F.col("explicit_section"), F.col("subject_code")).alias("section_type"),
        (
            (F.size("placeholders") > 0)
            | contains_any(F.upper(text), ["[MATH_GRAPH", "[VARIATION_TABLE]"])
        ).alias("has_diagram"),
        "placeholders",
    )


# Synthetic page spans of chapters and lessons.
CHAPTER_PAGES, FIRST_PAGE, LESSON_PAGES = 20, 5, 8


def flatten_taxonomy(documents: DataFrame) -> DataFrame:
    """Nested domains > subjects > grades > chapters > lessons > patterns to nodes with codes and
    synthetic page spans. One row of ``documents`` is one taxonomy file.
    """
    rows = documents.select(F.posexplode("domains").alias("_i1", "_d"))
    rows = rows.select("_i1", F.posexplode("_d.subjects").alias("_i2", "_s"))
    rows = rows.select(
        "_i1", "_i2", F.col("_s.subjectCode").alias("subject_code"),
        F.posexplode("_s.grades").alias("_i3", "_g"),
    )
    rows = rows.select(
        "_i1", "_i2", "_i3", "subject_code",
        F.coalesce("_g.grade", F.lit(12)).cast("int").alias("grade"),
        F.posexplode("_g.chapters").alias("_c", "_chapter"),
    )
    rows = rows.select(
        "_i1", "_i2", "_i3", "subject_code", "grade", "_c",
        F.coalesce("_chapter.name", F.concat(F.lit("Chương "), F.col("_c") + 1)).alias("chapter_name"),
        F.posexplode_outer("_chapter.lessons").alias("_l", "_lesson"),
    )
    rows = rows.select(
        "*",
        F.coalesce("_lesson.name", F.concat(F.lit("Bài "), F.col("_l") + 1)).alias("lesson_name"),
        F.posexplode_outer("_lesson.patterns").alias("_p", "_pattern"),
    )
    first_page = F.col("_c") * CHAPTER_PAGES + FIRST_PAGE
    return rows.select(
        F.struct("_i1", "_i2", "_i3", "_c", "_l", "_p").alias("position"),
        "subject_code", "grade", "chapter_name", "lesson_name",
        F.coalesce("_pattern", F.concat(F.lit("Dạng "), F.col("_p") + 1)).alias("pattern_name"),
        F.concat(
            F.lit("C"), F.col("_c") + 1, F.lit("_B"), F.col("_l") + 1, F.lit("_D"), F.col("_p") + 1
        ).alias("pattern_code"),
        ((F.col("_p") + 1) % 3 + 1).alias("bloom_level"),
        (first_page + F.col("_l") * LESSON_PAGES).alias("page_start"),
        (first_page + (F.col("_l") + 1) * LESSON_PAGES).alias("page_end"),
    )
