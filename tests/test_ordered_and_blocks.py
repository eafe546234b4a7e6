import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.operators import blocks, graph, node_mapping, ordered, retrieval, substrings, textbook

SMALL = {"broadcast_bytes": 0, "block_rows": 7}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    data = []
    for key, n in (("hot", 120), ("a", 7), ("b", 1)):
        at = sorted(rng.choice(400, size=n, replace=False).tolist())
        data += [(key, int(t), int(rng.integers(0, 9)) if rng.random() < 0.4 else None) for t in at]
    return spark.createDataFrame(data, "k string, t bigint, v int")


def by_key():
    return Window.partitionBy("k").orderBy("t")


def test_dense_index(series):
    got = ordered.dense_index(series, ["k"], [F.col("t")], ordered.bucket_of(F.col("t"), 16))
    want = series.withColumn("idx", (F.row_number().over(by_key()) - 1).cast("bigint"))
    assert rows(got, "k", "t", "idx") == rows(want, "k", "t", "idx")


def test_running_sum(series):
    got = ordered.running_sum(
        series, ["k"], [F.col("t")], ordered.bucket_of(F.col("t"), 16), {"s": F.coalesce("v", F.lit(0))}
    )
    want = series.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(by_key()))
    assert rows(got, "k", "t", "s") == rows(want, "k", "t", "s")


@pytest.mark.parametrize("current", [True, False])
def test_carry_last(series, current):
    got = ordered.carry_last(
        series, ["k"], ["t"], ordered.bucket_of(F.col("t"), 16), {"c": F.col("v")}, current
    )
    frame = by_key().rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = series.withColumn("c", F.last("v", ignorenulls=True).over(frame))
    assert rows(got, "k", "t", "c") == rows(want, "k", "t", "c")


def test_preceding_rows(series):
    placed = series.withColumn("i", F.row_number().over(by_key()) - 1)
    got = ordered.preceding_rows(placed, ["k"], "i", 6, F.col("t"), "h", size=10)
    want = placed.withColumn("h", F.collect_list("t").over(by_key().rowsBetween(-6, -1)))
    assert rows(got, "k", "t", "h") == rows(want, "k", "t", "h")


@pytest.mark.parametrize("fan", [512, 3])
def test_running_grades_by_buckets(spark, monkeypatch, fan):
    monkeypatch.setattr(textbook, "BUCKETS_PER_GROUP", fan)
    rng = np.random.default_rng(5)
    data, want = [], []
    for source, n in (("x", 60), ("y", 3)):
        grade = 9
        for page in range(1, n + 1):
            tag = int(rng.integers(10, 13)) if rng.random() < 0.1 else None
            moves = {
                g: (int(rng.integers(10, 13)) if rng.random() < 0.3 else None) for g in (-1, 10, 11, 12)
            }
            read = tag if tag is not None else grade
            after = moves[read if read in moves else -1]
            data.append((source, page, 9, tag, moves))
            grade = after if after is not None else read
            want.append((source, page, read, grade))
    steps = spark.createDataFrame(
        data, "source_id string, page_number int, start_grade int, tag_grade int, moves map<int,int>"
    )
    for size in (4, 512):
        got = textbook.running_grades(steps, bucket_pages=size)
        assert rows(got, "source_id", "page_number", "grade_read", "grade") == sorted(want, key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    data = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(60)]
    return spark.createDataFrame(data, "id bigint, grp int, embedding array<double>")


def test_vector_search_paths_agree(vectors):
    q = vectors.where("id < 20").withColumnRenamed("id", "qid")
    bank = vectors.where("id >= 15").withColumnRenamed("id", "bid")
    raw = {r["id"]: np.array(r["embedding"]) for r in vectors.collect()}

    def cosine(a, b):
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)

    want = []
    for i in range(20):
        near = sorted(((-cosine(raw[i], raw[j]), j) for j in range(15, 60)))[:4]
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(near)]
    columns = ("qid", "bid", "similarity", "rank")
    for options in ({}, {"bank_is_large": True}, SMALL, {"bank_is_large": True, **SMALL}):
        got = rows(retrieval.vector_top_k(q, bank, "qid", "bid", 4, **options), *columns)
        assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in sorted(want, key=repr)]
    scoped = retrieval.vector_top_k(
        q, bank.withColumnRenamed("grp", "bg"), "qid", "bid", 50, query_scope="grp", bank_scope="bg"
    )
    assert scoped.count() == sum(1 for i in range(20) for j in range(15, 60) if i % 3 == j % 3)


def test_zero_vectors_match_nothing(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid bigint, embedding array<double>")
    bank = spark.createDataFrame([(2, [1.0, 0.0])], "bid bigint, embedding array<double>")
    assert retrieval.vector_top_k(q, bank, "qid", "bid", 1).count() == 0


def test_keyword_search(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [("c1", "Hàm số BẬC hai", "s1"), ("c2", "đạo hàm", "s2"), ("c3", "khác", "s1"), ("c4", "bậc", "s2")],
        "chunk_id string, content string, skill_id string",
    )
    asked = spark.createDataFrame(
        [(1, "hàm bậc bậc", None), (2, "", None), (3, "hàm", "S2")],
        "id bigint, query string, skill_id string",
    )
    for options, limit in (({}, 0), ({"broadcast_bytes": 0}, 500_000), ({"broadcast_bytes": 0}, 0)):
        monkeypatch.setattr(substrings, "BROADCAST_GRAMS", limit)
        monkeypatch.setattr(retrieval, "BROADCAST_GRAMS", limit)
        got = retrieval.keyword_top_k(asked, chunks, "id", skill="skill_id", k=2, **options)
        assert rows(got, "id", "chunk_id", "score", "rank") == [
            (1, "c1", 1.0, 1), (1, "c4", pytest.approx(2 / 3), 2),
            (2, "c1", 0.5, 1), (2, "c2", 0.5, 2),
            (3, "c2", 1.0, 1), (3, "c4", 0.0, 2),
        ]


def test_mapping_and_matching_paths_agree(spark):
    nodes = spark.createDataFrame(
        [
            (i, f"S{i % 4}", "MATH", 10 + i % 3, ["Toán", "Tiếng Anh"][i % 2], f"Chương {i}: loại {i % 5} dài",
             f"Bài {i}: từ khóa {i % 7}", f"Dạng 1: mẫu{i % 6} chung{i % 4}")
            for i in range(30)
        ],
        "ord bigint, skill_id string, subject_code string, grade int, domain_name string, "
        "chapter_name string, lesson_name string, pattern_name string",
    )
    texts = spark.createDataFrame(
        [(i, f"loại {i % 5} dài mẫu{i % 6} chung{i % 4} từ khóa {i % 7}", None, f"mẫu{i % 6}", "MATH") for i in range(25)],
        "question_id bigint, content string, passage_excerpt string, suggested_skill_name string, subject_code string",
    )
    columns = ("question_id", "ord", "confidence")
    assert rows(node_mapping.map_questions(texts, nodes), *columns) == rows(
        node_mapping.map_questions(texts, nodes, **SMALL), *columns
    )
    pages = texts.selectExpr("cast(question_id as string) _page", "content clean_text", "subject_code")
    columns = ("_page", "running_grade", "ord", "score")
    assert rows(textbook.match_nodes(pages, nodes), *columns) == rows(
        textbook.match_nodes(pages, nodes, **SMALL), *columns
    )


def test_exemplars_against_plain_overlap(spark):
    rng = np.random.default_rng(2)
    words = ["lim", "x^2", "dx", "sin", "cos", "tan", "ln"]
    texts = [" ".join(rng.choice(words, size=4)) for _ in range(40)]
    q = spark.createDataFrame([(i, f"A{i % 3}", texts[i]) for i in range(20)], "question_id bigint, archetype_id string, text string")
    e = spark.createDataFrame([(i, f"A{i % 3}", texts[i], i) for i in range(20, 40)], "exemplar_id bigint, archetype_id string, question_latex string, created_at bigint")
    want = []
    for i in range(20):
        own = set(texts[i].split())
        near = sorted(
            (-round(len(own & set(texts[j].split())) / len(own | set(texts[j].split())), 4), j)
            for j in range(20, 40) if j % 3 == i % 3
        )[:2]
        want += [(i, j, -r) for r, j in near]
    got = graph.nearest_exemplars(q, e)
    assert rows(got, "question_id", "exemplar_id", "text_match_ratio") == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [blocks.BROADCAST_BYTES, 0])
def test_attach_dimension_in_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "DIMENSION_BLOCK", 3)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", limit)
    keys = spark.range(4).withColumnRenamed("id", "k")
    dimension = spark.range(10).withColumnRenamed("id", "v")
    got = blocks.attach_dimension(keys, dimension, "all").select("k", F.explode("all.v").alias("v"))
    assert rows(got) == sorted([(k, v) for k in range(4) for v in range(10)], key=repr)


def test_phrases_in_texts(spark):
    rng = np.random.default_rng(4)
    letters = list("abc d\n")
    made = ["".join(rng.choice(letters, size=rng.integers(1, 12))) for _ in range(60)]
    phrases = sorted({t[i : i + n] for t in made for i in (0, 2) for n in (1, 2, 3, 5) if t[i : i + n]} | {"zzz", "q"})
    texts = spark.createDataFrame([(t,) for t in sorted(set(made))], "text string")
    got = substrings.containing(texts, "text", spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert rows(got) == sorted(((t, p) for t in set(made) for p in phrases if p in t), key=repr)


def test_registered_keyword_search_by_index(spark, monkeypatch):
    from tools.check import compare, connect

    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    text, ok = compare(spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", "keyword_search")
    assert ok, text
