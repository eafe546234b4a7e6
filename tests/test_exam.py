from conftest import rows
from pyspark.sql import functions as F

from gradus.operators import exam_merge, exam_text, item_bank, node_mapping


def parse(spark, text, pages=1):
    exam = spark.createDataFrame([("e", text, pages)], "exam_id string, text string, total_pages int")
    exam = exam.withColumn("text", exam_text.repaired(F.col("text")))
    return {k: v.collect() for k, v in exam_text.parse(exam).items()}


def test_two_page_exam(spark):
    text = """--- PAGE_1 ---
Câu 1. Góc  bằng
A. 90 độ
B. 180 độ
C. 270 độ
D. 360 độ
Câu 2: Tìm x  3
A. 1 B. 2 C. 3 D. 4
--- PAGE_2 ---
Dựa vào thông tin dưới đây, trả lời các câu hỏi từ câu 3 đến 4
Dựa vào các thông tin sau và trả lời câu hỏi từ 3 đến 4:
Một đoạn văn.
Câu 3. Ý chính?
A. a
B. b
Câu 4. Kết luận?
A. c
B. d
Questions 5-6: read the passage
Solar power is growing.
Question 5. What grows?
A. Wind
B. Solar power
Question 6. She A go B to C the D market
A B C D
--- HẾT ---
Giám thị"""
    got = parse(spark, text)
    q = {r["question_number"]: r for r in got["questions"]}
    assert sorted(q) == [1, 2, 3, 4, 5, 6]
    assert "\\pi" in q[1]["content"] and q[1]["page_number"] == 1 and q[1]["option_b"] == "180 độ"
    assert "\\le" in q[2]["content"] and q[2]["option_d"] == "4"
    assert q[3]["page_number"] == 2 and (q[3]["passage_start"], q[3]["passage_end"]) == (3, 4)
    assert q[5]["option_b"] == "Solar power" and q[5]["passage_start"] == 5
    assert q[6]["option_a"] == "A" and "Giám thị" not in q[6]["content"]
    passages = {r["start_question"]: r["content"] for r in got["passages"]}
    assert sorted(passages) == [3, 5] and passages[5] == "Solar power is growing."
    total = got["totals"][0]
    assert (total["total_pages"], total["total_passages"], total["total_single_questions"]) == (2, 2, 2)


def test_bare_numbers(spark):
    text = """Đề
--- PAGE_10 ---
91. Phản ứng ở cực âm
A. Pb -> Pb2+ + 2e.
B. khác
92. Chọn
A. x
B. y
Đọc thông tin sau và trả lời các câu hỏi từ 118 đến 120
Thí nghiệm gồm hai bước.
118. Bước một
A. m
B. n
119. Không có phương án
119. Bước hai
A. p
B. q
120. Bước ba
A. r
B. s"""
    got = parse(spark, text)
    q = {r["question_number"]: r for r in got["questions"]}
    assert sorted(q) == [91, 92, 118, 119, 120]
    assert q[91]["page_number"] == 10 and q[91]["option_a"] == "Pb -> Pb2+ + 2e."
    assert q[119]["content"] == "Bước hai"
    passage = got["passages"][0]
    assert passage["content"] == "Thí nghiệm gồm hai bước." and passage["questions"] == 3


def test_first_occurrence_and_text_start(spark):
    got = parse(spark, "Câu 1. đầu\nCâu 2:\nCâu 1. lặp\nCâu 2. sau\nCâu 501. xa")
    assert [(r["question_number"], r["content"]) for r in got["questions"]] == [(1, "đầu")]


MERGE = (
    "exam_id string, question_number int, arrival bigint, page_number int, content string, "
    "options map<string,string>, correct_option string, explanation string, difficulty_level int"
)


def test_batches_merge(spark):
    data = [
        ("e", 31, 1, 5, "ba mốt", {"A": "1"}, "C.", None, 0),
        ("e", 53, 2, 16, "năm ba", {"A": "1", "B": "2"}, "A", None, 9),
        ("e", 54, 3, 16, "năm tư", {}, "(B)", None, 3),
        ("e", 54, 4, 16, "năm tư", {}, "D", "vì", 3),
        ("e", 54, 5, 16, "khác", {}, "D", "vì", 3),
        ("e", 0, 6, 16, "không số", {}, "D", "vì", 3),
    ]
    merged = exam_merge.merge_questions(spark.createDataFrame(data, MERGE))
    assert rows(merged, "question_number", "correct_option", "difficulty_level", "arrival") == [
        (31, "C", 2, 1), (53, "A", 6, 2), (54, "D", 3, 4),
    ]
    parts = spark.createDataFrame(
        [("e", 53, 54, 1, " Đoạn ", None), ("e", 53, 54, 2, "ĐOẠN", "/1"), ("e", 53, 54, 3, "Đoạn dài", "/2"),
         ("e", 53, 54, 4, "thêm", None), ("e", 9, 2, 5, "sai", None)],
        "exam_id string, start_question int, end_question int, arrival bigint, content string, image_url string",
    )
    passages = exam_merge.stitch_passages(parts)
    assert rows(passages, "content", "image_url") == [("Đoạn dài\n\nthêm", "/1")]
    placed = exam_merge.place_questions(merged, passages)
    assert rows(placed, "question_number", "passage_start") == [(31, None), (53, 53), (54, 53)]
    pages = spark.createDataFrame([("e", 2)], "exam_id string, total_pages int")
    total = exam_merge.merged_totals(placed, passages, pages).first()
    assert (total["total_passages"], total["total_single_questions"], total["total_pages"]) == (1, 1, 16)


def test_answer_keys(spark):
    raw = [None, "", "b", "2", "Đáp án C", "(D)", "BANANA", "xyz", "4", "[d].", "phương án a!"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = df.select(
        "i", exam_merge.correct_option(F.col("raw")), exam_merge.correct_option_loose(F.col("raw"))
    ).orderBy("i").collect()
    assert [r[1] for r in got] == ["A", "A", "B", "C", "C", "D", "B", "A", "A", "D", "A"]
    assert [r[2] for r in got] == ["A", "A", "B", "C", "C", "D", "A", "A", "D", "D", "A"]


def test_images_go_to_items_that_point_to_figures(spark):
    passages = spark.createDataFrame(
        [("e", 1, 1, 3, "Quan sát sơ đồ"), ("e", 1, 4, 6, "bảng số liệu và hình vẽ")],
        "exam_id string, page_number int, start_question int, end_question int, content string",
    )
    singles = spark.createDataFrame(
        [("e", 1, 9, "như hình"), ("e", 1, 8, "không"), ("e", 1, 7, "ở hình"), ("e", 2, 10, "hình bên")],
        "exam_id string, page_number int, question_number int, content string",
    )
    images = spark.createDataFrame(
        [("e", 1, 5.0, "b"), ("e", 1, 1.0, "a"), ("e", 3, 1.0, "c")],
        "exam_id string, page_number int, y double, url string",
    )
    got = exam_merge.assign_images(passages, singles, images)
    assert rows(got, "kind", "item", "url") == [("passage", 1, "a"), ("question", 7, "b")]


def test_figures_of_passages_are_found_without_their_texts(spark):
    texts = ["như hình", "thí nghiệm", "một hình", "bảng số liệu", "Sơ đồ", "sơ đồ và hơn", " ", "NHƯ HÌNH trên"]
    data = [(e, 1 + e % 2, 2, i, texts[(e * 3 + i * (1 + e // 8)) % 8]) for e in range(40) for i in range(1 + e % 3)]
    parts = spark.createDataFrame(
        [(*d, None) for d in [*data, (99, 0, 2, 1, "như hình"), (99, 3, 2, 1, "như hình")]],
        "exam_id int, start_question int, end_question int, arrival int, content string, image_url string",
    )
    stitched = exam_merge.stitch_passages(parts)
    want = stitched.withColumn("wants_figure", exam_merge.wants_figure(F.col("content"), True))
    keys = exam_merge.PASSAGE_KEYS
    found = exam_merge.figure_passages(parts)
    assert rows(found) == rows(want, *keys, "wants_figure")
    assert {r["wants_figure"] for r in found.collect()} == {True, False}
    assert rows(exam_merge.passage_ranges(parts)) == rows(stitched, *keys)


def test_merging_shuffles_only_what_is_kept(spark):
    data = [("e", 1, i, i, "x" * i, {"A": "a"}, "B", None, 2) for i in range(1, 4)]
    merged = exam_merge.merge_questions(spark.createDataFrame(data, MERGE), ["page_number"])
    assert merged.columns == ["exam_id", "question_number", "page_number"] and rows(merged) == [("e", 1, 3)]


def test_pieces_are_read_once(spark):
    text = "Đề\r\n\r\n--- PAGE_2 ---\nCâu 1: x A. a B. b\nDựa vào thông tin sau, trả lời câu hỏi từ 2 đến 3:\nĐoạn\n2. y\nA. a\nB. b\n3. z\nCâu 600: w"
    exam = spark.createDataFrame([("e", text, 3), ("none", None, 3)], "exam_id string, text string, total_pages int")
    whole, lean = exam_text.parse(exam), exam_text.parse(exam, texts=False)
    assert rows(whole["questions"], "question_number", "page_number", "content", "passage_start") == [
        (1, 2, "x", None), (2, 2, "y", 2)
    ]
    for name in ("totals", "passages"):
        assert rows(whole[name]) == rows(lean[name]) and whole[name].columns == lean[name].columns
    assert rows(lean["passages"], "start_question", "content", "questions") == [(2, "Đoạn", 1)]
    cut = exam_text.pieces(exam)
    assert rows(cut.where("exam_id = 'none'")) == []
    assert rows(exam_text.rejects(cut), "pos", "first") == [(4, 600)]
    plan = exam_text.rejects(cut)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


NODES = [
    (0, "S1", "Toán học", "Chương 1: Đạo hàm", "Bài 1: Cực trị của hàm số", "Dạng 1: Tìm cực trị hàm số"),
    (1, "S2", "Khoa học tự nhiên", "Hóa học: Ester", "Bài 2: Phản ứng xà phòng hóa ester", "Dạng 2: Thủy phân ester"),
    (2, "S3", "Khoa học tự nhiên", "Vật lí: Dao động", "Bài 3: Con lắc lò xo", "Dạng 3: Chu kì con lắc lò xo"),
    (3, "S4", "Tiếng Anh", "Tiếng Anh: Grammar", "Error identification", "Find the error in a sentence"),
]


def test_node_mapping(spark):
    nodes = spark.createDataFrame(
        NODES, "ord int, skill_id string, domain_name string, chapter_name string, lesson_name string, pattern_name string"
    )
    questions = spark.createDataFrame(
        [
            (1, "Tìm cực trị của hàm số y = x^3", None, "Cực trị hàm số", "MATH"),
            (2, "Xà phòng hóa hoàn toàn ester X", None, None, "GENERAL"),
            (3, "The error is in the sentence that she has written for the error", None, None, "GENERAL"),
            (4, "zzz", None, None, None),
        ],
        "question_id int, content string, passage_excerpt string, suggested_skill_name string, subject_code string",
    )
    got = {r["question_id"]: r for r in node_mapping.map_questions(questions, nodes).collect()}
    assert got[1]["ord"] == 0 and got[1]["confidence"] >= 0.6
    assert got[2]["ord"] == 1 and got[3]["ord"] == 3 and 4 not in got
    primary = spark.createDataFrame([(1, 2)], "question_id int, ord int")
    chosen = node_mapping.prefer_primary(questions, primary, node_mapping.map_questions(questions, nodes))
    assert rows(chosen, "question_id", "ord", "provider") == [(1, 2, "PRIMARY"), (2, 1, "LEXICAL"), (3, 3, "LEXICAL")]


def test_assembly(spark):
    bank = spark.createDataFrame(
        [(i, "dom_math" if i < 3 else "dom_lang", 1 + i % 2) for i in range(5)], "item_id int, domain_id string, bloom int"
    )
    requests = spark.createDataFrame(
        [(1, "ALL", None, 1, "Đề Môn Toán"), (2, "dom_lang", 2, 6, None), (3, "dom_x", 0, 99, ""), (4, "dom_math", 6, 5, "")],
        "request_id int, domain_id string, bloom_level int, question_count int, prompt string",
    )
    got = {}
    for r in item_bank.assemble(requests, bank).orderBy("request_id", "position").collect():
        got.setdefault(r["request_id"], []).append(r["item_id"])
    assert got[1] == [0, 1, 2, 0, 1]
    assert got[2] == [3] * 6
    assert got[3] == [i % 5 for i in range(99)]
    assert item_bank.assemble(requests, bank, most=50).where("request_id = 3").count() == 50
    assert got[4] == [0, 1, 2, 0, 1]


def test_rejects_and_ends_of_bodies(spark):
    text = """Câu 1. Một
A. a
B. b
Dựa vào dãy điện hóa này, chọn đáp án
C. c
Câu 501. Quá lớn
A. a B. b
Câu 99999999999. Không đọc được
Câu 2. Hai
Dựa vào thông tin sau, trả lời câu hỏi từ 9 đến 2
ngược
Câu 3. Ba --- PAGE_4 --- còn nữa
Đọc văn bản và trả lời câu hỏi từ 4 đến 40
dài
--- PAGE_5 ---
Câu 4. Bốn
A. x
B. y"""
    exam = spark.createDataFrame([("e", text, 1)], "exam_id string, text string, total_pages int")
    cut = exam_text.pieces(exam)
    assert [r["page_number"] for r in cut.orderBy("pos").collect()] == [1, 1, 1, 1, 1, 1, 5]
    got = exam_text.rejects(cut)
    assert rows(got, "pos", "kind", "first", "last", "reason") == [
        (2, "QUESTION", 501, None, "NUMBER_OUT_OF_RANGE"),
        (3, "QUESTION", None, None, "NUMBER_OUT_OF_RANGE"),
        (4, "PASSAGE", 9, 2, "BACKWARDS"),
        (5, "PASSAGE", 4, 40, "SPAN_TOO_LONG"),
    ]
    q = {r["question_number"]: r for r in exam_text.questions(cut).collect()}
    # An electrochemical series opens a passage, and does not end a question's body.
    assert "dãy điện hóa" in q[1]["option_b"] and q[1]["option_c"] == "c"
    assert sorted(q) == [1, 2, 3, 4] and q[3]["content"].startswith("Ba") and "PAGE" not in q[3]["content"]


def test_exams_meet_only_places_that_are_reached(spark):
    bank = spark.range(2000).select(
        F.col("id").alias("item_id"), F.lit("dom_math").alias("domain_id"),
        (F.col("id") % 6 + 1).cast("int").alias("bloom"), F.concat(F.lit("k"), "id").alias("correct"),
    )
    requests = spark.range(30).select(
        F.col("id").alias("request_id"), F.lit("ALL").alias("domain_id"), (F.col("id") % 8).cast("int").alias("bloom_level"),
        (F.col("id") + 1).cast("int").alias("question_count"), F.lit("").alias("prompt"),
    )
    found = item_bank.assemble(requests, bank, columns=("correct", "bloom"))
    plain = item_bank.assemble(requests, bank).join(bank.drop("domain_id"), "item_id")
    assert rows(found) == rows(plain, *found.columns) and found.count() == sum(max(5, i + 1) for i in range(30))
    assert max(r["item_id"] for r in found.collect()) < 30 * 6
