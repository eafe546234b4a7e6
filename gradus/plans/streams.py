"""Streaming jobs, run over the supplied files until all is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.markers import Markers
from gradus.operators import catalog as catalog_ops
from gradus.operators import chunking
from gradus.plans import query, views
from gradus.plans.novelty import _DETECT, THRESHOLD
from gradus.plans.psychometrics import _golden
from gradus.session import scratch_folder
from gradus.sources.snapshots import SnapshotStore
from gradus.sources.tables import table
from gradus.streaming import jobs


#: More files than a part is written in: each run reads all of it as one batch.
WHOLE_PART = 1_000_000


#: What arrives late: every eleventh event, and half of those of the last three hours.
_LATE = "(event_id % 11 = 0 OR event_id % 2 = 1 AND ts > (SELECT max(ts) FROM events) - INTERVAL 3 HOUR)"
#: The watermark that the last file meets: ten minutes behind all that came before it.
_MARK = f"""mark AS (
  SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS met,
         (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE AS last
  FROM events WHERE NOT {_LATE})"""


def _delivered(spark: SparkSession, d: str, resent: bool = False) -> DataFrame:
    """The events with the file ``_part`` they come in: the later half of the time second, and what is
    late third. With ``resent`` some of the others come again in the third."""
    events = table(spark, d, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    ts, i = F.col("ts"), F.col("event_id")
    late = (i % 11 == 0) | ((i % 2 == 1) & (ts > F.lit(high) - F.expr("INTERVAL 3 HOURS")))
    part = F.when(late, 2).when(ts < F.lit(low + (high - low) / 2), 0).otherwise(1)
    rows = events.withColumn("_part", part)
    return rows.unionByName(rows.where("event_id % 13 = 5").withColumn("_part", F.lit(2))) if resent else rows


def _finished(
    delivered: DataFrame, shape: Callable[[DataFrame], DataFrame], schema: str, mode: str
) -> DataFrame:
    """What a stream has written, per batch, after its three files: each is read by a run of its own,
    which goes on from the state and the watermark that the one before left."""
    spark = delivered.sparkSession
    folder = scratch_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for part in range(3):
        rows = delivered.where(F.col("_part") == part).drop("_part")
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = jobs.file_stream(spark, f"{folder}/in", rows.schema, files_per_trigger=WHOLE_PART)
        running = (
            shape(stream)
            .writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out")


_ANSWERS = f"""{_MARK},
items AS (
  SELECT user_id AS student_id, event_type <> 'error' AS is_correct,
         CASE event_id % 7 + 1 WHEN 1 THEN -1.8 WHEN 2 THEN -1.0 WHEN 3 THEN -0.2 WHEN 4 THEN 0.6
              WHEN 5 THEN 1.4 WHEN 6 THEN 2.2 ELSE 0.0 END::DOUBLE AS b,
         CASE WHEN floor(value) < 5 THEN 0.1 ELSE 1.2 END::DOUBLE AS a
  FROM events, mark WHERE NOT {_LATE} OR ts > met)"""


@query(
    "stream_running_ability",
    f"""WITH RECURSIVE {_ANSWERS}, {_golden('items', 'student_id', 'overall')}
SELECT student_id, theta, count(*) AS total_questions, count(*) FILTER (is_correct) AS correct_count,
       CASE WHEN theta < -0.5 THEN 'FOUNDATION' WHEN theta > 0.5 THEN 'BREAKTHROUGH' ELSE 'ACCELERATION' END
         AS placement_class
FROM overall JOIN items USING (student_id) GROUP BY student_id, theta""",
)
def stream_running_ability(spark: SparkSession, d: str) -> DataFrame:
    """Late answers are dropped by the watermark, answers sent twice count once."""
    i = F.col("event_id")

    def shape(events: DataFrame) -> DataFrame:
        answers = events.select(
            F.col("user_id").alias("student_id"),
            i.alias("answer_no"),
            i.alias("question_id"),
            (i % 7 + 1).cast("int").alias("difficulty_level"),
            (F.col("event_type") != "error").alias("is_correct"),
            F.col("value").cast("int").alias("time_spent_seconds"),
            F.col("ts").cast("timestamp").alias("answered_at"),
        )
        return jobs.running_ability(answers)

    schema = "student_id bigint, theta double, placement_class string, total_questions bigint, correct_count bigint"
    rows = _finished(_delivered(spark, d, resent=True), shape, schema, "update")
    latest = rows.groupBy("student_id").agg(
        F.max_by(F.struct("theta", "placement_class", "total_questions", "correct_count"), "batch").alias("_r")
    )
    return latest.select("student_id", "_r.*")


MARKERS = Markers(persona=("click",), knowledge=("view",))


@query(
    "stream_turn_rates",
    f"""WITH {_MARK},
t AS (
  SELECT date_trunc('hour', ts) AS window_start, CASE WHEN event_type = 'view' THEN 'C5' ELSE 'C1' END AS category,
         event_type = 'error' AND user_id % 2 = 0 AS leaked, {_LATE} AS late FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, category, count(*) AS turns, count(*) FILTER (leaked) AS leaks
FROM t, mark
WHERE window_start + INTERVAL 1 HOUR <= last AND (NOT late OR window_start + INTERVAL 1 HOUR > met)
GROUP BY ALL""",
)
def stream_turn_rates(spark: SparkSession, d: str) -> DataFrame:
    """A late turn counts where its hour is still open, and is dropped where that was given out."""

    def shape(events: DataFrame) -> DataFrame:
        turns = events.select(
            F.col("ts").cast("timestamp").alias("asked_at"),
            F.lit("").alias("question_latex"),
            F.col("event_type").alias("query"),
            F.array().cast("array<struct<role:string,text:string>>").alias("history"),
            F.when(F.col("event_type") == "error", "Đáp án là B").otherwise("Em thử lại").alias("reply"),
            F.when(F.col("user_id") % 2 == 0, "B").otherwise("C").alias("correct_option"),
        )
        return jobs.turn_rates(turns, MARKERS)

    schema = "window_start timestamp, category string, turns bigint, leaks bigint"
    rows = _finished(_delivered(spark, d), shape, schema, "append")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "category", "turns", "leaks",
    )


def _sessions(source: str, name: str) -> str:
    return f"""{name}_steps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM {source}),
{name} AS (
  SELECT *, min(ts) OVER s AS first_ts, max(ts) OVER s + INTERVAL 6 HOUR AS closes
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM {name}_steps)
  WINDOW s AS (PARTITION BY user_id, n))"""


@query(
    "stream_sessions",
    f"""WITH {_MARK},
on_time AS (SELECT user_id, ts FROM events WHERE NOT {_LATE}),
{_sessions("on_time", "early")},
still AS (
  SELECT user_id, ts FROM early, mark WHERE closes > met
  UNION ALL SELECT user_id, ts FROM events, mark WHERE {_LATE} AND ts + INTERVAL 6 HOUR > met),
{_sessions("still", "later")}
SELECT user_id AS conv_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS turns
FROM (SELECT user_id, first_ts, closes, met AS mark_met FROM early, mark
      UNION ALL SELECT user_id, first_ts, closes, last AS mark_met FROM later, mark)
WHERE closes <= mark_met GROUP BY user_id, first_ts, closes""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A late turn joins a session that is still open; one that was given out is not opened again."""

    def shape(events: DataFrame) -> DataFrame:
        turns = events.select(
            F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("asked_at")
        )
        return jobs.conversation_sessions(turns, gap="6 hours")

    schema = "conv_id bigint, session_start timestamp, session_end timestamp, turns bigint"
    rows = _finished(_delivered(spark, d), shape, schema, "append")
    return rows.select(
        "conv_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "turns"
    )


@query(
    "stream_novelty_staging",
    f"""WITH {_DETECT},
texts AS (
  SELECT question_text, md5('proposal#' || question_text) < '8' AS decided,
         bool_or(question_id % 3 < 2) AS early, bool_or(question_id % 3 = 2) AS late
  FROM detected WHERE status = 'NOVEL_PATTERN_CANDIDATE' GROUP BY question_text)
SELECT question_text, CAST(early AS BIGINT) + CAST(late AND (NOT early OR decided) AS BIGINT) AS proposals
FROM texts""",
)
def stream_novelty_staging(spark: SparkSession, d: str) -> DataFrame:
    """Three batches, a restart that replays nothing, and a review before the last batch."""
    folder = scratch_folder(spark)
    store = SnapshotStore(spark, f"{folder}/store")
    questions = views.novelty_questions(spark, d)
    archetypes = views.centroids(spark, d)

    def run() -> None:
        stream = jobs.file_stream(spark, f"{folder}/in", questions.schema, files_per_trigger=WHOLE_PART)
        writer = jobs.novelty_staging(stream, archetypes, store, f"{folder}/state", THRESHOLD)
        writer.trigger(availableNow=True).start().awaitTermination()

    for part in range(3):
        own = questions.where(F.col("question_id") % 3 == part)
        own.write.mode("append").parquet(f"{folder}/in")
        if part == 2:
            decided = store.appended("proposals", jobs.PROPOSALS).where("id < '8'")
            store.publish({"reviews": decided.select("id")})
        run()
        run()
    return (
        store.appended("proposals", jobs.PROPOSALS)
        .groupBy(F.col("raw_question_latex").alias("question_text"))
        .agg(F.countDistinct("id").alias("proposals"))
    )


_PARTS = 3
_CHUNKS = "document_id string, chunk_id string, chunk_index int, content string"


class _Killed(SnapshotStore):
    """A store whose driver dies once, after a batch's chunks are written and before its commit."""

    def __init__(self, spark: SparkSession, base: str, batch: int) -> None:
        super().__init__(spark, base)
        self.batch = batch

    def publish(self, tables, stream=None, batch=None):
        if batch == self.batch:
            self.batch = None
            raise RuntimeError("killed between append and publish")
        return super().publish(tables, stream, batch)


def ingested(spark: SparkSession, d: str, killed: int | None) -> tuple[SnapshotStore, int]:
    """A store after three batches of all uploads, and how many runs failed. The batch ``killed``
    dies between its two writes and is replayed by the next run."""
    folder = scratch_folder(spark)
    store = _Killed(spark, f"{folder}/store", killed)
    uploads = views.uploads(spark, d)
    store.publish({"catalog": views.prior_catalog(spark, d)})
    last = uploads.agg(F.max("arrival")).first()[0] or 0

    def chunk(batch: DataFrame) -> DataFrame:
        texts = batch.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
        return chunking.paragraph_chunks(texts, "arrival", "content")

    def run() -> bool:
        stream = jobs.file_stream(spark, f"{folder}/in", uploads.schema, files_per_trigger=WHOLE_PART)
        writer = jobs.ingest(stream, store, chunk, f"{folder}/state")
        running = writer.trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except StreamingQueryException as error:
            if "killed between" not in str(error):
                raise
            return False
        return True

    failed = 0
    for part in range(_PARTS):
        mine = F.col("arrival") * _PARTS / F.lit(last + 1)
        uploads.where(F.floor(mine) == part).write.mode("append").parquet(f"{folder}/in")
        while not run():
            failed += 1
    return store, failed


@query(
    "stream_versioned_ingest",
    f"""WITH {views.DECISIONS},
parts AS (SELECT arrival * {_PARTS} // (max(arrival) OVER () + 1) AS part, * FROM decisions),
part_winners AS (
  SELECT document_group_id, part, max(version) AS winner, arg_max(uploaded_at, version) AS swapped_at
  FROM parts WHERE action <> 'UNCHANGED' GROUP BY document_group_id, part),
lost AS (
  SELECT *, lead(swapped_at) OVER (PARTITION BY document_group_id ORDER BY part) AS lost_at,
         row_number() OVER (PARTITION BY document_group_id ORDER BY part) AS nth FROM part_winners),
live AS (
  SELECT document_id, count(*) AS chunks, sum(length({views.STRIP.format('content')}))::BIGINT AS chars
  FROM paragraphs GROUP BY document_id)
SELECT s.id, s.document_group_id, s.file_name, s.version, s.file_hash, s.status, s.is_current, s.total_chunks,
       coalesce(CASE WHEN s.version = 3 AND p.is_current AND p.id = s.id THEN first.swapped_at ELSE own.lost_at END,
                s.created_at) AS updated_at,
       coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars
FROM snapshot s LEFT JOIN live ON live.document_id = s.id
LEFT JOIN prior p ON p.id = s.id
LEFT JOIN lost AS first ON first.document_group_id = s.document_group_id AND first.nth = 1
LEFT JOIN lost AS own ON own.document_group_id = s.document_group_id AND own.winner = s.version AND p.id IS NULL""",
)
def stream_versioned_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of uploads, the second killed between its chunks and its catalog and replayed:
    the catalog and the chunks of each version are those of the batch operators."""
    store, _ = ingested(spark, d, killed=1)
    catalog = store.read("catalog", catalog_ops.CATALOG_SCHEMA)
    chunks = jobs.ingested_chunks(store, _CHUNKS).groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars")
    )
    zero = F.lit(0).cast("bigint")
    return catalog.drop("error_message", "created_at").join(chunks, "id", "left").withColumns(
        {"chunks": F.coalesce("chunks", zero), "chars": F.coalesce("chars", zero)}
    )
