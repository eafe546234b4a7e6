from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradus.operators import dialogue as ops
from gradus.operators import interactions as log_ops

ITEM = "Cho hàm số $y = x^3 - 3x$. Tìm cực trị của hàm số."
ASK = "question_latex string, query string, history array<string>"


def labels(spark, *asks):
    df = spark.createDataFrame([(q, a, h) for q, a, h in asks], ASK)
    return [
        (r["category"], r["student_mood"], r["target_focus"]) for r in ops.label(df).collect()
    ]


def test_task_context(spark):
    data = [(ITEM, "em hỏi"), ("", "x"), ("Câu hỏi của học sinh", "x"), ("  Chào  thầy", "chào thầy"), (None, None)]
    df = spark.createDataFrame(data, "q string, a string")
    got = [r[0] for r in df.select(ops.has_task(F.col("q"), F.col("a"))).collect()]
    assert got == [True, False, False, False, False]


@pytest.mark.parametrize(
    "question,query,history,category,mood,focus",
    [
        ("", "thầy là ai", [], "C1", "NEUTRAL", "PERSONA"),
        (ITEM, "thầy có bằng thạc sĩ không mà giải câu này", [], "C2", "SKEPTICAL", "CONCEPT_EXPLANATION"),
        (ITEM, "Đề bài sai rồi", [], "C3", "NEUTRAL", "EXAM_VALIDITY"),
        (ITEM, "Vì sao chọn B?", [], "C4", "CURIOUS", "CONCEPT_EXPLANATION"),
        (ITEM, "", [], "C4", "NEUTRAL", "CONCEPT_EXPLANATION"),
        (ITEM, "giải giúp em bài toán tích phân từ 0 đến 1 của e^x", [], "C5", "NEUTRAL", "STEP_HINT"),
        ("", "công thức tính đạo hàm là gì", [], "C5", "CURIOUS", "STEP_HINT"),
        (ITEM, "khó quá", ["trước"], "C2", "FRUSTRATED", "CONCEPT_EXPLANATION"),
        (ITEM, "gợi ý bước tiếp theo", [], "C4", "NEUTRAL", "STEP_HINT"),
    ],
)
def test_categories(spark, question, query, history, category, mood, focus):
    assert labels(spark, (question, query, history)) == [(category, mood, focus)]


def test_short_markers_are_whole_words(spark):
    assert labels(spark, (ITEM, "chi tiết hơn", []))[0][0] == "C4"
    assert labels(spark, (ITEM, "hi", []))[0][0] == "C1"


def test_label_repair(spark):
    labelled = spark.createDataFrame([(1, False, "C1"), (2, True, "C4")], "id int, has_task_context boolean, category string")
    external = spark.createDataFrame(
        [(1, "C4", "NEUTRAL", "STEP_HINT"), (2, "C4", "CURIOUS", "PERSONA")],
        "id int, ext_category string, ext_mood string, ext_focus string",
    )
    got = ops.repair_labels(labelled, external, ["id"])
    assert rows(got, "id", "category", "target_focus", "repaired") == [
        (1, "C1", "PERSONA", True), (2, "C4", "CONCEPT_EXPLANATION", True),
    ]


def test_answer_leaks(spark):
    data = [
        ("Em nên chọn phương án B", "B", True), ("Đáp án đúng là b.", " b ", True), ("chọn đáp án C", "B", False),
        ("chọn Bài", "B", False), ("kết quả là B", "B", True), ("đáp án B", None, False), ("đáp án G", "G", False),
    ]
    df = spark.createDataFrame(data, "reply string, correct string, want boolean")
    got = df.select(ops.leaks_answer(F.col("reply"), F.col("correct")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_criteria(spark):
    df = spark.createDataFrame(
        [("C1", True, False, {"redirect_to_learning": True}), ("C4", False, False, {"grounded_in_theorems": False}),
         ("C4", True, False, {"grounded_in_theorems": False}), ("C5", True, True, {}), ("zz", True, False, {})],
        "category string, grounded boolean, revealed boolean, verdicts map<string,boolean>",
    )
    criteria = ops.required_criteria(F.col("category"), F.col("grounded"))
    got = df.select(ops.passes(F.col("revealed"), F.col("verdicts"), criteria)).collect()
    assert [r[0] for r in got] == [True, True, False, False, True]


def test_greetings(spark):
    data = [
        ("Chào thầy!", ITEM, None), ("hello mọi người", "", None), (None, "xin chào.", None), ("câu này giải sao", ITEM, None),
        ("", "xin chào", {"A": "một phương án khá dài", "B": "b", "C": "c"}), ("", "", None),
    ]
    df = spark.createDataFrame(data, "query string, stem string, options map<string,string>")
    got = df.select(ops.is_greeting(F.col("query"), F.col("stem"), F.col("options"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False]


def test_history(spark):
    turns = spark.createDataFrame(
        [("c", i, "assistant" if i % 2 else "user", " " if i == 3 else f"t{i}" * 300) for i in range(10)],
        "conv_id string, turn bigint, role string, text string",
    )
    got = {r["turn"]: r["history"] for r in ops.with_history(turns).collect()}
    assert 3 not in got and got[0] == []
    assert [h["text"][:2] for h in got[9]] == ["t2", "t4", "t5", "t6", "t7", "t8"]
    assert got[9][1]["role"] == "student" and len(got[9][0]["text"]) == 600
    short = {r["turn"]: r["history"] for r in ops.with_history(turns, chars=500).collect()}
    assert len(short[9][0]["text"]) == 500


def test_prompt_rendering(spark):
    df = spark.createDataFrame([("Hi {{a}} {{b}} {{a}}", {"a": "x", "b": None})], "t string, v map<string,string>")
    assert df.select(ops.render(F.col("t"), F.col("v"))).first()[0] == "Hi x  x"


LOG = (
    "id string, student_id string, question_id string, archetype_id string, student_selected_option string, "
    "correct_option string, matched_trap_id string, transcript string, validation_status string, "
    "student_reported boolean, mentor_resolution string, created_at timestamp_ntz"
)


def log(spark):
    at = datetime(2024, 5, 6, 7, 8, 9)
    data = [
        ("1", "s", "q1", "A", "C", "B", "T", '[{"role":"tutor","text":"gợi ý"}]', None, False, None, at),
        ("2", "s", "q2", None, None, None, None, "hỏng", "PASSED", False, "ĐÃ XEM", at),
    ]
    return spark.createDataFrame(data, LOG)


def test_interaction_log(spark):
    names = spark.createDataFrame([("A", "P1", "Tên", "Định lý")], "archetype_id string, pattern_code string, pattern_name string, core_theorems string")
    traps = spark.createDataFrame([("T", "TC", "Bẫy", "Sai")], "trap_id string, trap_code string, trap_name string, misconception_explanation string")
    got = {r["id"]: r for r in log_ops.audit_list(log(spark), names, traps).collect()}
    assert got["1"]["trap_code"] == "TC" and got["1"]["validation_status"] == "PASSED"
    assert got["1"]["created_at"] == "2024-05-06T07:08:09Z" and got["1"]["transcript"][0]["text"] == "gợi ý"
    assert got["2"]["transcript"] == [] and got["2"]["pattern_code"] is None
    reports = spark.createDataFrame([(1, "1", " sai "), (2, "2", None), (3, "9", None)], "report_no int, interaction_id string, reason string")
    updated, unknown = log_ops.apply_reports(log(spark), reports)
    assert rows(updated, "id", "student_reported", "mentor_resolution") == [("1", True, "REPORTED: sai"), ("2", True, "ĐÃ XEM")]
    assert rows(unknown, "interaction_id") == [("9",)]


def test_mentor_actions(spark):
    events = spark.createDataFrame(
        [(1, "1", None, None, "lời giải", None, ["b1"], datetime(2024, 1, 1)), (2, "2", None, "đề", "x", "D", [], datetime(2024, 1, 1)),
         (3, "9", "A", None, "x", None, [], datetime(2024, 1, 1))],
        "event_id int, interaction_id string, archetype_id string, question_latex string, golden_solution string, "
        "correct_option string, explanation_steps array<string>, created_at timestamp_ntz",
    )
    fresh, after, rejects = log_ops.override_exemplars(log(spark), events)
    assert rows(fresh, "archetype_id", "question_latex", "correct_option") == [("A", "Question q1", "B")]
    assert rows(after, "id", "mentor_resolution") == [("1", log_ops.EXEMPLAR_SAVED), ("2", "ĐÃ XEM")]
    assert rows(rejects, "event_id", "reason") == [(2, "NO_ARCHETYPE"), (3, "NOT_FOUND")]
    events = spark.createDataFrame(
        [(7, "1", None, None, "Bẫy", None, "vì", "gợi")],
        "event_id int, interaction_id string, archetype_id string, trap_code string, trap_name string, "
        "wrong_option string, misconception_explanation string, socratic_hint string",
    )
    trap, after, _ = log_ops.add_traps(log(spark), events)
    row = trap.first()
    assert row["trap_code"].startswith("TRAP_MENTOR_") and row["wrong_option"] == "C"
    assert rows(after, "mentor_resolution")[0] == (log_ops.TRAP_ADDED,) or ("NEW_TRAP_ADDED",) in rows(after, "mentor_resolution")
