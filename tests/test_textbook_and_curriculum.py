import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradus.operators import curriculum, textbook


@pytest.mark.parametrize(
    "name,text,subject,grade,edition",
    [
        ("SGK Toán 12 - Chân trời sáng tạo.pdf", "nguyên hàm", "MATH", 12, "Chân trời sáng tạo"),
        ("Ngữ văn 10 KNTT.pdf", "", "VIET", 10, "Kết nối tri thức với cuộc sống"),
        ("Âm nhạc lớp 11.pdf", "", "OUT_OF_SCOPE_DGNL", 11, "GDPT 2018"),
        ("a.pdf", "cân bằng hóa học", "CHEM", 11, "Chân trời sáng tạo"),
    ],
)
def test_identity(spark, name, text, subject, grade, edition):
    df = spark.createDataFrame([(name, text)], "file_name string, sample_text string")
    got = textbook.identify(df, ["âm nhạc"]).first()
    assert (got["subject_code"], got["grade"], got["book_edition"]) == (subject, grade, edition)
    assert got["is_in_scope"] == (subject != "OUT_OF_SCOPE_DGNL")


def test_identity_hints(spark):
    df = spark.createDataFrame(
        [("x", "", None, "khxh", None), ("x", "", "chem ", None, 10), ("x", "", "AUTO", "lang", 0)],
        "file_name string, sample_text string, hint_subject string, hint_domain string, hint_grade int",
    )
    got = [(r["subject_code"], r["grade"]) for r in textbook.identify(df, []).collect()]
    assert got == [("HIST", 12), ("CHEM", 10), ("VIET", 12)]


def test_noise_and_encoding(spark):
    text = "12\n Hình 1.2 Sơ đồ \nNội dung\n\nNguồn: báo\nEm có biết?\n  Dòng hai "
    got = textbook.clean_pages(spark.createDataFrame([(text,)], "text string")).first()
    assert (got["clean_text"], got["removed_lines"]) == ("Nội dung\nDòng hai", 4)
    texts = ["ngắn {}^~", "Văn bản tiếng Việt bình thường, đủ dài để kiểm tra.", "¶§©® lỗi phông chữ nặng nề ở trang này", "bcdfg hjklm npqrs tvwxz bcdfg hjklm npqrs"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(textbook.is_corrupted(F.col("text"))).collect()] == [False, False, True, True]


NODES = [
    (0, "MATH", 12, "Chương 1: Ứng dụng đạo hàm", "Bài 1: Tính đơn điệu", "Dạng 1: Xét dấu"),
    (1, "MATH", 12, "Chương 2: Nguyên hàm tích phân", "Bài 4: Nguyên hàm cơ bản", "Dạng 1: Bảng nguyên hàm"),
    (2, "MATH", 11, "Chương 3: Cấp số", "Bài 2: Cấp số cộng", "Dạng 1: Công sai"),
]
NODE_SCHEMA = "ord int, subject_code string, grade int, chapter_name string, lesson_name string, pattern_name string"


def classify(spark, *texts):
    pages = spark.createDataFrame(
        [("s", i + 1, t) for i, t in enumerate(texts)], "source_id string, page_number int, text string"
    )
    sources = spark.createDataFrame(
        [("s", "MATH", 12, "Cánh diều")], "source_id string, subject_code string, grade int, book_edition string"
    )
    out = textbook.classify_pages(pages, sources, spark.createDataFrame(NODES, NODE_SCHEMA))
    return out.orderBy("page_number").collect()


def test_pages_carry_structure(spark):
    got = classify(
        spark,
        "không có gì",
        "# Chương 2: Tiêu đề riêng\nBài 7. Bài riêng\nnội dung",
        'Ví dụ 1. Tính nguyên hàm cơ bản\n[IMAGE_PLACEHOLDER: type="graph_2d" | desc="đồ thị"]',
        "tiếp theo",
        '[TAXONOMY: subject="Hóa học" | grade="11" | pattern=\'Riêng\' | section="exercise"] trang mới',
        "Tổng chủ biên và lời nói đầu",
    )
    assert got[0]["chapter_name"] == NODES[0][3] and got[0]["lesson_name"] == NODES[0][4]
    assert got[1]["chapter_name"] == "Chương 2: Tiêu đề riêng" and got[1]["lesson_name"] == "Bài 7. Bài riêng"
    assert got[2]["lesson_name"] == NODES[1][4] and got[2]["section_type"] == "EXAMPLE"
    assert got[2]["has_diagram"] and got[2]["placeholders"][0]["diagram_type"] == "GRAPH_2D"
    assert got[2]["placeholders"][0]["id"] == "img_p3_1" and 'id="img_p3_1" page="3"' in got[2]["text"]
    assert got[3]["lesson_name"] == NODES[1][4] and got[3]["section_type"] == "THEORY"
    assert (got[4]["subject_code"], got[4]["grade"], got[4]["pattern_name"]) == ("CHEM", 11, "Riêng")
    assert got[4]["section_type"] == "EXERCISE" and "TAXONOMY" not in got[4]["text"]
    assert got[5]["section_type"] == "COVER" and got[5]["chapter_name"] == "Thông tin xuất bản"


def test_captions_become_placeholders(spark):
    got = classify(spark, "mở đầu\nHình 2.1: Sơ đồ mạch\nkết")[0]
    assert got["placeholders"][0]["diagram_type"] == "LAB_DIAGRAM"
    assert got["text"].startswith("mở đầu\nHình 2.1: Sơ đồ mạch\n[IMAGE_PLACEHOLDER: id=")
    assert got["text"].endswith("kết")


def test_diagrams_alone_need_no_taxonomy(spark):
    pages = spark.createDataFrame(
        [("s", 1, '[TAXONOMY: subject="Toán"]'), ("s", 2, "Hình 2.1: Sơ đồ mạch"), ("t", 1, "chữ"), ("t", 2, "Hình 3: Cây bút chì")],
        "source_id string, page_number int, text string",
    )
    sources = spark.createDataFrame(
        [("s", "PHYS", 9, "b"), ("t", "MATH", 9, "b")], "source_id string, subject_code string, grade int, book_edition string"
    )
    nodes = spark.createDataFrame(
        [(0, "MATH", 10, "Chương 1: Véc tơ", "Bài 1: Lực", "Dạng 1: Tổng")],
        "ord long, subject_code string, grade int, chapter_name string, lesson_name string, pattern_name string",
    )
    found = textbook.page_diagrams(pages, sources)
    want = textbook.classify_pages(pages, sources, nodes).select("source_id", F.inline("placeholders"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect())) != []
    assert "InPandas" not in found._jdf.queryExecution().toString()


def chunk(page, section="THEORY", chapter="Chương A", lesson="Bài A", pattern="Dạng 4: P", text="t"):
    return ("s", page, page, text, len(text), "CHEM", "Hóa học", 12, "Cánh diều", chapter, lesson, pattern, section, 0)


CHUNKS = (
    "source_id string, page_number int, chunk_index int, text string, char_count int, subject_code string, "
    "subject_name string, grade int, book_edition string, chapter_name string, lesson_name string, "
    "pattern_name string, section_type string, diagrams int"
)


def test_roll_up(spark):
    data = [chunk(i, text=f"lt{i}") for i in range(1, 7)] + [chunk(9, "EXERCISE", text="bt"), chunk(10, "COVER", pattern=None, text="bìa")]
    got = curriculum.roll_up(spark.createDataFrame(data, CHUNKS)).orderBy("pattern_number").collect()
    assert [r["pattern_name"] for r in got] == ["Dạng 1: P", "Dạng 2: Kiến thức & Kỹ năng cốt lõi"]
    assert got[0]["chapter_name"] == "[Lớp 12 - Cánh diều] Chương A" and got[0]["chapter_weight"] == 1.0
    assert "lt4" in got[0]["theory_recap"] and "lt5" not in got[0]["theory_recap"]
    assert "bt" in got[0]["solution_method"] and "bìa" in got[1]["theory_recap"]
    assert (got[0]["page_start"], got[0]["page_end"]) == (1, 10)


def test_pattern_dedupe(spark):
    patterns = spark.createDataFrame(
        [("l", "L", 1, "Dạng 5: Cực trị"), ("l", "L", 2, "dạng 2: CỰC TRỊ"), ("l", "L", 3, "Dạng 1: "), ("l", "L", 4, "Mới")],
        "lesson_id string, lesson_name string, position bigint, pattern_name string",
    )
    names = [r["pattern_name"] for r in curriculum.dedupe_patterns(patterns).orderBy("owner").collect()]
    assert names == ["Dạng 1: Cực trị", "Dạng 2: Trọng tâm kiến thức L phần 2", "Dạng 3: Mới"]
    questions = spark.createDataFrame(
        [("l", 1, 1, "a"), ("l", 1, 2, "a"), ("l", 2, 1, "a"), ("l", 2, 2, "b"), ("l", 2, 3, "b")],
        "lesson_id string, position bigint, question_no bigint, content string",
    )
    kept = curriculum.merge_pattern_questions(patterns, questions)
    assert rows(kept, "position", "question_no", "content") == [(1, 1, "a"), (1, 2, "a"), (2, 2, "b")]


def test_sections_hold_every_chunk_in_order(spark):
    data = [
        ("s", page, page * 10 + k, f"text {page}/{k}", "Toán", 10, "Cánh diều", "C", None if k else "L", "P", kind, 0)
        for page in range(1, 60)
        for k, kind in enumerate(["THEORY", "EXAMPLE", "FORMULA", "COVER"])
    ]
    chunks = spark.createDataFrame(
        data,
        "source_id string, page_number int, chunk_index int, text string, subject_name string, grade int, "
        "book_edition string, chapter_name string, lesson_name string, pattern_name string, section_type string, diagrams int",
    )
    got = curriculum.roll_up_sections(chunks).collect()
    assert len(got) == len(data)
    sections = {}
    for r in sorted(got, key=lambda r: (r.page_number, r.chunk_index)):
        ranks, chars = sections.setdefault((r.lesson, r.kind), [0, 0])
        sections[r.lesson, r.kind] = [ranks + 1, chars + len(r.part)]
        assert [r.section_rank, r.chars_so_far] == sections[r.lesson, r.kind]
    some = curriculum.roll_up_sections(chunks, {"THEORY": 3, "EXAMPLE": 1}).collect()
    assert len(some) == 2 * 3 + 1  # theory under two lessons, examples under one
    wide = curriculum.roll_up(chunks, {"THEORY": 1000, "EXAMPLE": 1000, "EXERCISE": 1000}).collect()
    assert sum(r.theory_recap.count("[Trang") for r in wide) >= 59 * 3


def test_word_edges_of_ascii_are_those_of_the_sql(spark):
    import duckdb

    from gradus.functions.text import words_of
    from gradus.operators import node_mapping

    texts = [
        "straß 10 e", "straß_10_x", "x 10 ä", "x 10 y", "lớp\u00a010", "lớp\x0b11 ", "lớp 12", "ßester und", "ester",
        "öreading comprehension", "đạo hàm", "a cdß", "_cd.", "ä cd ", "inßgelich isä is", "their ſhe theüis", "",
    ]
    patterns = [textbook.GRADE_NAMES.format(n=n) for n in (10, 11, 12)]
    patterns += [rf"\b({t})\b" for _, t in textbook.GRADE_TOPICS] + [p for _, _, p in textbook.EDITIONS if p]
    patterns += [rf"\b({r[5]})\b" for r in textbook.SUBJECT_RULES] + [r[4] for r in textbook.SUBJECT_RULES if r[4]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[F.col("t").rlike(words_of(p, True)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    unicode = df.select(*[F.col("t").rlike(words_of(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    con = duckdb.connect()
    ask = lambda q, *a: con.execute(q, a).fetchone()[0]
    want = [[ask("SELECT regexp_matches(?, ?)", t, p) for p in patterns] for t in texts]
    assert [list(r)[1:] for r in got] == want
    assert [list(r) for r in unicode] != want
    english = rf"(?i)\b({'|'.join(node_mapping.ENGLISH_WORDS)})\b"
    hits = [ask("SELECT len(regexp_extract_all(?, ?))", t, english) for t in texts]
    found = F.size(F.regexp_extract_all("t", F.lit(words_of(english, True).replace("(?i)", "(?iu)")), F.lit(1)))
    assert [r[0] for r in df.select(found).collect()] == hits
    signs = lambda a: df.select(node_mapping.language_signs(F.concat(F.lit("the of inß "), "t"), a)[1]).collect()
    assert [r[0] for r in signs(True)] != [r[0] for r in signs(False)]
