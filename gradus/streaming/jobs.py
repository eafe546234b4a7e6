"""Streaming forms of the batch jobs. Each gives the result of its batch operator on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from gradus.functions import irt
from gradus.functions.markers import Markers
from gradus.functions.text import stable_id
from gradus.operators import catalog, dialogue, novelty, psychometrics
from gradus.sources.snapshots import SnapshotStore

PROPOSALS = (
    "id string, source_exam_name string, raw_question_latex string, image_urls array<string>, "
    "extracted_metadata string, max_similarity_score double, nearest_archetype_id string, "
    "status string, academic_feedback string, created_at timestamp_ntz"
)
REVIEWS = "id string"
WATERMARK = "10 minutes"


def file_stream(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def ingest(
    uploads: DataFrame,
    store: SnapshotStore,
    chunk: Callable[[DataFrame], DataFrame],
    checkpoint: str,
) -> DataStreamWriter:
    """Versioned ingest of a stream of uploads.

    ``chunk`` turns uploads into rows keyed by arrival. Chunks are appended per batch and never
    rewritten: which of them are live follows from the catalog (``catalog.flag_chunks``), and only
    the catalog's snapshot is replaced. Both become visible with one commit: chunks are read with
    ``ingested_chunks``, which passes over those of a batch that died before it was published. Its
    replay decides on the same catalog and writes the same folder again; a batch that was published
    but not yet marked done by Spark is recognised by its number and changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        if store.last_batch("ingest") >= number:
            return
        known = store.read("catalog", catalog.CATALOG_SCHEMA)
        hashed, _ = catalog.hash_uploads(batch)
        decisions = catalog.decide_versions(hashed, known)
        store.append("chunks", catalog.with_document(chunk(batch), decisions), number)
        counts = (
            batch.sparkSession.read.parquet(f"{store.base}/chunks/batch={number}")
            .groupBy("document_id")
            .agg(F.count(F.lit(1)).alias("chunks"))
        )
        after = catalog.swap(known, catalog.register_pending(decisions), counts)
        store.publish({"catalog": after}, "ingest", number)

    return uploads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def ingested_chunks(store: SnapshotStore, schema: str) -> DataFrame:
    """Chunks of all batches that ``ingest`` has published."""
    return store.appended("chunks", schema, stream="ingest")


def running_ability(
    responses: DataFrame,
    model: irt.ItemModel = psychometrics.DEFAULT_MODEL,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Ability per student after each batch, for the students it touched (update mode).

    State per student is the row of counts that the estimate needs, whatever the number of answers.
    A question answered again within the watermark counts once. ``responses`` adds answered_at.
    """
    once = responses.withWatermark("answered_at", watermark).dropDuplicatesWithinWatermark(
        ["student_id", "question_id"]
    )
    counts = psychometrics.answer_counts(once, ["student_id"], model)
    return psychometrics.ability(counts, model).select(
        "student_id", "theta", irt.placement(F.col("theta")).alias("placement_class"),
        "total_questions", "correct_count",
    )


def novelty_staging(
    questions: DataFrame,
    archetypes: DataFrame,
    store: SnapshotStore,
    checkpoint: str,
    threshold: float = novelty.THRESHOLD,
) -> DataStreamWriter:
    """Novel questions of each batch are appended as proposals, once per text that is pending.

    The store's ``reviews`` table names the proposals that were decided. Their texts are no longer
    pending: met again, they are proposed anew under an id of their own.
    """

    def run(batch: DataFrame, number: int) -> None:
        earlier = store.appended("proposals", PROPOSALS, before=number)
        reviewed = store.read("reviews", REVIEWS).select("id").distinct()
        good, _ = novelty.with_text(batch)
        found = novelty.detect(good, archetypes, threshold)
        _, fresh = novelty.stage(found, earlier.join(reviewed, "id", "left_anti"))
        known = earlier.select("id", F.lit(True).alias("_known")).distinct()
        own = F.when(F.col("_known"), stable_id(F.lit("again"), F.col("id"), F.lit(number)))
        fresh = fresh.join(known, "id", "left").withColumn("id", F.coalesce(own, "id"))
        store.append("proposals", fresh.drop("_known"), number)

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def turn_rates(
    turns: DataFrame, markers: Markers = dialogue.DEFAULT_MARKERS, window: str = "1 hour",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Counts per window and category, with answers given away (append mode).

    ``turns``: asked_at, question_latex, query, history, reply, correct_option.
    """
    labelled = dialogue.label(turns, markers).withColumn(
        "leaked", dialogue.leaks_answer(F.col("reply"), F.col("correct_option"))
    )
    return (
        labelled.withWatermark("asked_at", watermark)
        .groupBy(F.window("asked_at", window), "category")
        .agg(F.count(F.lit(1)).alias("turns"), F.count_if("leaked").alias("leaks"))
        .select(F.col("window.start").alias("window_start"), "category", "turns", "leaks")
    )


def conversation_sessions(turns: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of each conversation, closed by a gap (append mode). ``turns``: conv_id, asked_at."""
    return (
        turns.withWatermark("asked_at", watermark)
        .groupBy(F.session_window("asked_at", gap), "conv_id")
        .agg(F.count(F.lit(1)).alias("turns"))
        .select(
            "conv_id",
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "turns",
        )
    )
