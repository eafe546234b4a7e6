import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradus.operators import graph, novelty
from gradus.sources.snapshots import SnapshotStore
from gradus.streaming import jobs

TRAPS = [("A", f"T_{x}", f"T_{x}", f"trap {x}", x, f"why {x}", f"hint {x}") for x in "BCD"]
TRAP_SCHEMA = (
    "archetype_id string, trap_id string, trap_code string, trap_name string, wrong_option string, "
    "misconception_explanation string, socratic_hint string"
)
ASK_SCHEMA = (
    "question_id int, archetype_id string, selected_option string, correct_option string, "
    "is_exemplar boolean"
)


def test_grounding_bounds(spark):
    data = spark.createDataFrame([(None,), (0.75,), (0.749,)], "s double")
    got = [r[0] for r in data.select(graph.grounding(F.col("s"))).collect()]
    assert got == ["NOT_FOUND", "GROUNDED", "LOW_CONFIDENCE"]


def test_trap_resolution(spark):
    asks = spark.createDataFrame(
        [
            (1, "A", "c", "A", True), (2, "A", "B", "A", False), (3, "A", "a", "A", True),
            (4, "none", "B", "A", True), (5, "one", "D", "A", True), (6, "A", None, "A", True),
        ],
        ASK_SCHEMA,
    )
    traps = spark.createDataFrame([*TRAPS, ("one", "X", "X", "x", "B", "w", "h")], TRAP_SCHEMA)
    resolved = graph.resolve_traps(asks, traps)
    assert rows(resolved, "question_id", "strategy", "matched_trap_id", "candidate_count") == [
        (1, "EXEMPLAR_OPTION_LETTER", "T_C", 0),
        (2, "ARCHETYPE_CANDIDATES", None, 3),
        (3, "NONE", None, 0),
        (4, "NONE", None, 0),
        (5, "ARCHETYPE_CANDIDATES", None, 1),
        (6, "ARCHETYPE_CANDIDATES", None, 3),
    ]
    assert graph.candidate_traps(resolved, traps).count() == 7


def test_candidates_of_one_archetype_are_made_by_many_tasks(spark):
    asks = spark.range(300).select(
        F.col("id").alias("question_id"), F.when(F.col("id") < 290, "A").otherwise("B").alias("archetype_id"),
        F.lit("ARCHETYPE_CANDIDATES").alias("strategy"),
    )
    traps = spark.range(200).select(
        F.when(F.col("id") < 190, "A").otherwise("C").alias("archetype_id"), F.concat(F.lit("T"), "id").alias("trap_id")
    )
    found = graph.candidate_traps(asks, traps, side=10).withColumn("_task", F.spark_partition_id())
    got = found.groupBy("_task").count().agg(F.sum("count"), F.max("count")).first()
    assert got[0] == 290 * 190 and got[1] < 290 * 190 / 8
    assert found.drop("_task").exceptAll(asks.drop("strategy").join(traps, "archetype_id").select(*found.columns[:-1])).count() == 0


def test_match_form(spark):
    got = spark.range(1).select(graph.match_form(F.lit("  $20\\pi$  cm/s "))).first()[0]
    assert got == "20pi cm/s"
    q = spark.createDataFrame([(1, "A", "T = $0{,}5$ s")], "question_id int, archetype_id string, text string")
    e = spark.createDataFrame([("e", "A", "T = 0,5 s", 1)], "exemplar_id string, archetype_id string, question_latex string, created_at int")
    assert graph.nearest_exemplars(q, e).first()["text_match_ratio"] == 1.0


def test_word_overlap(spark):
    got = spark.range(1).select(
        graph.word_overlap(F.lit("a b c a"), F.lit("b c d")), graph.word_overlap(F.lit(""), F.lit(""))
    ).first()
    assert tuple(got) == (0.5, 1.0)


def questions(spark):
    data = [
        (1, "exam", " Tìm\n m ", {"B": " 2 ", "A": "1", "C": " "}, 3, "A", None, [1.0, 0.0]),
        (2, "exam", "Khác hẳn", None, 4, None, "/i.png", [0.6, 0.8]),
        (3, "exam", "Khác hẳn", None, 5, None, None, [0.6, 0.8]),
        (4, "exam", "  ", None, 6, None, None, [1.0, 0.0]),
    ]
    return spark.createDataFrame(
        data,
        "question_id int, source_exam string, content string, options map<string,string>, "
        "question_number int, correct_option string, image_url string, embedding array<double>",
    ).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def archetypes(spark):
    return spark.createDataFrame([("A", [1.0, 0.0])], "archetype_id string, embedding array<double>")


def test_question_text_and_threshold(spark):
    good, bad = novelty.with_text(questions(spark))
    assert rows(good, "question_id", "question_text")[0] == (1, "Tìm m A. 1 B. 2")
    assert rows(bad, "question_id", "reason") == [(4, "EMPTY_CONTENT")]
    at = novelty.detect(good, archetypes(spark), threshold=0.6)
    assert rows(at, "question_id", "max_similarity", "status")[1] == (2, 0.6, novelty.MATCHED)
    above = novelty.detect(good, archetypes(spark), threshold=0.600001)
    assert rows(above, "question_id", "status")[1] == (2, novelty.NOVEL)
    nothing = archetypes(spark).where("false")
    assert rows(novelty.detect(good, nothing), "max_similarity", "nearest_archetype_id")[0] == (0.0, None)


def test_staging_is_idempotent(spark):
    good, _ = novelty.with_text(questions(spark))
    found = novelty.detect(good, archetypes(spark))
    none = spark.createDataFrame([], jobs.PROPOSALS)
    staged, fresh = novelty.stage(found, none)
    assert rows(staged, "question_id", "duplicate_proposal") == [(2, False), (3, True)]
    assert fresh.count() == 1
    assert '"question_number":4' in fresh.first()["extracted_metadata"]
    again, more = novelty.stage(found, fresh)
    assert more.count() == 0 and again.where("not duplicate_proposal").count() == 0
    totals = novelty.summary(found, staged).first()
    assert (totals["total"], totals["matched_existing"], totals["novel_candidates"], totals["new_proposals"]) == (3, 1, 2, 1)
    empty = novelty.summary(found.where("false"), staged.where("false"))
    assert empty.count() == 0


def test_streamed_staging(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    source = questions(spark)
    schema = (
        "question_id int, source_exam string, content string, options map<string,string>, "
        "question_number int, correct_option string, image_url string, embedding array<double>, "
        "created_at timestamp_ntz"
    )
    for part in ("question_id <= 2", "question_id > 2"):
        source.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema)
        writer = jobs.novelty_staging(stream, archetypes(spark), store, str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    got = store.appended("proposals", jobs.PROPOSALS)
    good, _ = novelty.with_text(source)
    _, want = novelty.stage(
        novelty.detect(good, archetypes(spark)), spark.createDataFrame([], jobs.PROPOSALS)
    )
    assert rows(got, "id", "raw_question_latex") == rows(want, "id", "raw_question_latex")


def test_flatten_exam(spark):
    q = "struct<question_number:int,content:string>"
    exam = spark.createDataFrame(
        [("e", [(5, "five"), (1, " ")], [(2, 3, [(3, "three"), (2, "two")])])],
        f"exam_id string, single_questions array<{q}>, "
        f"passages array<struct<start_question:int,end_question:int,questions:array<{q}>>>",
    )
    flat = novelty.flatten_exams(exam).orderBy("question_number")
    assert [(r["question_number"], r["passage_range"]) for r in flat.collect()] == [(2, "2-3"), (3, "2-3"), (5, None)]


def test_review_rules(spark):
    proposals = novelty.stage(
        novelty.detect(novelty.with_text(questions(spark))[0], archetypes(spark)),
        spark.createDataFrame([], jobs.PROPOSALS),
    )[1]
    key = proposals.first()["id"]
    decisions = spark.createDataFrame(
        [
            (1, key, "MERGED", "n", None), (2, key, "MERGED", "n", "ZZ"), (3, key, "MERGED", "ok", "A"),
            (4, key, "REJECTED", "late", None), (5, "unknown", "APPROVED", "n", None),
        ],
        "decision_no int, proposal_id string, decision string, academic_feedback string, merged_into_archetype_id string",
    )
    updated, rejects = novelty.review(proposals, decisions, archetypes(spark))
    assert rows(updated, "status", "academic_feedback", "nearest_archetype_id") == [("MERGED", "ok", "A")]
    assert rows(rejects, "decision_no", "reason") == [
        (1, "MISSING_TARGET"), (2, "UNKNOWN_TARGET"), (4, "NOT_PENDING"), (5, "NOT_PENDING"),
    ]


def test_replace_children(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "archetype_id string, n int")
    new = spark.createDataFrame([("A", 9)], "archetype_id string, n int")
    assert rows(novelty.replace_children(old, new, new)) == [("A", 9), ("B", 2)]


@pytest.mark.parametrize("explanation,priority", [("Vì sao", 2), ("  ", 3)])
def test_material_priority(spark, explanation, priority):
    u = [f"{i:032d}" for i in range(5)]
    asks = spark.createDataFrame([(u[0], u[3]), ("bad id", u[3])], "question_id string, skill_id string")
    known = spark.createDataFrame([(u[0], u[2], explanation)], "question_id string, skill_id string, explanation string")
    lessons = spark.createDataFrame([(u[4], u[3], "t", "bài")], "material_id string, skill_id string, title string, content string")
    got = dict(rows(graph.materials_for(asks, known, lessons), "question_id", "priority"))
    assert got == {u[0]: priority, "bad id": 3}
