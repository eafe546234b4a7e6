"""Ordered computations over a key whose rows may be far too many for one task.

A window partitioned by such a key would send all of its rows to a single task. Here a key is
split into consecutive buckets of its order (``bucket`` must not decrease along ``order``). Each
bucket is summarised by a partially aggregated group-by, the few summaries of a key are scanned
by a window, and the result is carried into a window over (key, bucket), whose size the caller
sets by the choice of bucket. Values are the same as those of one window over the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
ROWS_PER_BUCKET = 100_000


def bucket_of(order_value: Column, size: int = ROWS_PER_BUCKET) -> Column:
    """Bucket for an integer order that is unique within its key: at most ``size`` rows each."""
    return F.floor(order_value / F.lit(size)).cast("bigint")


def _carry(
    df: DataFrame, keys: Sequence[str], bucket: Column, summaries: list[Column]
) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumn(BUCKET, bucket)
    return rows, rows.groupBy(*keys, BUCKET).agg(*summaries)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "idx"
) -> DataFrame:
    """0-based position of each row within its key."""
    rows, sizes = _carry(df, keys, bucket, [F.count(F.lit(1)).alias("_n")])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_offset", BUCKET)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Running sums up to and including the row: ``values`` maps new column to summed value."""
    names = list(values)
    df = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    rows, sums = _carry(df, keys, bucket, [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside) for n in names})
        .drop(BUCKET, *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: dict[str, Column],
    include_current: bool = True,
) -> DataFrame:
    """Latest non-null value so far: ``values`` maps new column to the value carried forward."""
    names = list(values)
    df = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    rows, lasts = _carry(
        df,
        keys,
        bucket,
        [
            F.max(
                F.when(
                    F.col(f"_v_{n}").isNotNull(),
                    F.struct(*[F.col(o) for o in order], F.col(f"_v_{n}").alias("_value")),
                )
            ).alias(f"_l_{n}")
            for n in names
        ],
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lasts.select(
        *keys,
        BUCKET,
        *[F.last(f"_l_{n}._value", ignorenulls=True).over(before).alias(f"_o_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumns(
            {
                n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_o_{n}"))
                for n in names
            }
        )
        .drop(BUCKET, *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])
    )


def preceding_rows(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    count: int,
    item: Column,
    out: str,
    size: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The ``count`` rows before each row, oldest first, as an array of ``item``.

    ``index`` is the dense position in the key. A bucket of positions borrows copies of the last
    ``count`` rows of the bucket before it, which is all that its own rows can look back to.
    """
    homes = F.array_distinct(
        F.array(F.floor(F.col(index) / size), F.floor((F.col(index) + count) / size))
    )
    spread = df.withColumn("_item", item).withColumn(BUCKET, F.explode(homes))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(index).rowsBetween(-count, -1)
    return (
        spread.withColumn(out, F.collect_list("_item").over(inside))
        .where(F.floor(F.col(index) / size) == F.col(BUCKET))
        .drop(BUCKET, "_item")
    )
