"""Mixing sources to target weights by capped water-filling.

All sources share the total size by weight. A source whose share is above ``epochs`` times its own
size stops there, and what it leaves is shared by the others, by weight, until none is above. With
sources ordered by size per weight those that stop come first, so running sums over the sources
give the same fixed point.

A source is then taken target / size times: every document the whole number of times, and once
more for documents in a seeded order until the fraction is met. The order is that of a hash of the
id, so reruns agree. The order is cut into buckets whose sizes are summed first; only the bucket in
which the fraction ends is looked at row by row, so a source with a third of all rows is no burden.

A null text has size 0, a null source is a source of its own and comes last, rows of equal id are
taken or left together in the fraction, an empty table gives no rows, a source of size 0 has target
0 and its documents are taken 0 times. Only the named columns are read; others pass through
``mixed`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import unused, word_count
from gradus.session import checkpointed

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that name its bucket: 4 096 buckets in each source.
BUCKET_DIGITS = 3


def seeded(id_column: str, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> with target. Windows are over sources, one row each."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("position") % len(weights))
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), "position")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    cap = F.lit(epochs) * F.col("source_size")
    shares = (
        sizes.withColumn("position", position)
        .withColumn("weight", weight)
        .withColumn(
            "left",
            F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        )
        .withColumn("sharing", F.sum("weight").over(onward))
        .withColumn(
            "stops",
            F.col("weight").cast("decimal(19,0)") * F.col("left")
            > cap.cast("decimal(19,0)") * F.col("sharing"),
        )
    )
    # The first source that does not stop says what is left to share and among which weights.
    first = F.min(
        F.when(
            ~F.col("stops"),
            F.struct(F.col("source_size") / F.col("weight"), "position", "left", "sharing"),
        )
    ).over(everything)
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(
        (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.sharing")
    )
    return shares.withColumn("first", first).select(
        "source", "source_size", target.alias("target")
    )


def plan(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): sizes and seeded order of each document; of each source the whole
    repetitions and the last hash that is taken once more."""
    docs = checkpointed(
        df.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            seeded(id_column, seed).alias("draw"),
        )
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(epochs))
    sources = (
        source_targets(sizes, weights, epochs)
        .withColumn("whole", F.coalesce(whole, F.lit(0)))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    buckets = docs.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("_size"))
    known = buckets.alias("b").join(
        sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))
    )
    running = Window.partitionBy("s.source").orderBy("bucket")
    ends = (
        known.withColumn("_upto", F.sum("_size").over(running))
        .where(F.col("_upto") - F.col("_size") < F.col("part"))
        .groupBy("s.source")
        .agg(F.max(F.struct("bucket", (F.col("_upto") - F.col("_size")).alias("before"), "part")).alias("end"))
    )
    inside = (
        docs.alias("d")
        .join(
            ends.alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.source")) & (bucket == F.col("e.end.bucket")),
        )
        .withColumn(
            "_upto",
            F.col("end.before")
            + F.sum("size").over(Window.partitionBy("d.source").orderBy("draw")),
        )
        .withColumn("_taken", F.col("_upto") - F.col("size") / 2 <= F.col("end.part"))
        .groupBy("d.source")
        .agg(
            F.max(F.when(F.col("_taken"), F.col("draw"))).alias("last"),
            F.first("end.bucket").alias("bucket"),
        )
        .select("source", F.coalesce("last", "bucket").alias("last"))
    )
    final = (
        sources.alias("s")
        .join(inside.alias("i"), F.col("s.source").eqNullSafe(F.col("i.source")), "left")
        .select("s.source", "source_size", "target", "whole", F.col("i.last"))
    )
    return docs, checkpointed(final)


def times(draw, whole, last, epochs: int = EPOCHS):
    once_more = F.coalesce((draw <= last).cast("bigint"), F.lit(0))
    return F.least(F.coalesce(whole, F.lit(0)) + once_more, F.lit(epochs)).cast("bigint")


def mixture(df: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    docs, sources = plan(df, **options)
    s = sources.alias("s")
    taken = F.col("size") * times(
        F.col("draw"), F.col("whole"), F.col("last"), options.get("epochs", EPOCHS)
    )
    return (
        docs.alias("d")
        .join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", taken.alias("taken"))
    )


def mixed(df: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row of ``df`` as often as it is taken, columns unchanged."""
    _, sources = plan(df, **options)
    id_column = options.get("id_column", "doc_id")
    source_column = options.get("source_column", "source")
    name = unused(df, "mix")
    count = times(
        seeded(id_column, options.get("seed", SEED)),
        F.col(f"{name}.whole"),
        F.col(f"{name}.last"),
        options.get("epochs", EPOCHS),
    )
    packed = sources.select(F.struct("source", "whole", "last").alias(name))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return (
        df.join(packed, F.col(f"`{source_column}`").eqNullSafe(F.col(f"{name}.source")))
        .select(*columns, F.explode(F.array_repeat(F.lit(0), count.cast("int"))).alias(name))
        .select(*columns)
    )


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position
  FROM docs GROUP BY source
), weighted AS (
  SELECT *, CASE position % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
), shares AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
      ORDER BY source_size / weight, position
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY source_size / weight, position
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM weighted
), stopping AS (
  SELECT *, weight * remaining > 3 * source_size * sharing AS stops FROM shares
), level AS (
  SELECT remaining, sharing FROM stopping WHERE NOT stops
  ORDER BY source_size / weight, position LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN stops THEN (3 * source_size)::DOUBLE
         ELSE (weight * (SELECT remaining FROM level))::DOUBLE / (SELECT sharing FROM level)
    END AS target
  FROM stopping
), parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END::BIGINT
    AS whole FROM targets
), running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
    p.target - p.whole * p.source_size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * least(whole + CASE WHEN part > 0 AND upto - size / 2 <= part THEN 1 ELSE 0 END, 3))::BIGINT
    AS taken
FROM running
"""


@query("op9_mixing", MIX_SQL)
def op9_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixture(read(spark, base, "documents"))
