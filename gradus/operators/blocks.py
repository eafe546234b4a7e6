"""Scoring every row of one table against every row of another, without a cross join.

The kernel gets two pandas blocks and returns the best few per row, so pairs are never emitted.
If the smaller table is proven small (its bytes are summed first) it is broadcast and the
larger one is only streamed past it. Otherwise both are cut into hash blocks and each pair of
blocks becomes one bounded group of a cogroup. Either way all pairs are considered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 128 * 1024 * 1024
BLOCK_ROWS = 16_384
DIMENSION_BLOCK = 4_096
SALTS = 64
# Kernels that hold a matrix of words by nodes take no more nodes than this at a time.
NODE_LIMITS = {"broadcast_rows": 2_048, "block_rows": 2_048}
CELLS_AT_ONCE = 4_000_000

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def score_blocks(
    large: DataFrame,
    small: DataFrame,
    large_key: str,
    small_key: str,
    kernel: Kernel,
    schema: str,
    small_bytes: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    broadcast_rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """The kernel's rows, and whether each large row has met the whole small table already."""
    size = small.agg(F.count(F.lit(1)).alias("rows"), F.sum(small_bytes).alias("bytes")).first()
    n_small = size["rows"]
    if n_small == 0:
        return large.sparkSession.createDataFrame([], schema), True
    if size["bytes"] <= broadcast_bytes and n_small <= (broadcast_rows or n_small):
        held = large.sparkSession.sparkContext.broadcast(small.toPandas())

        def stream(batches):
            for batch in batches:
                if len(batch):
                    yield kernel(batch, held.value)

        return large.mapInPandas(stream, schema), True

    n_large = large.count()
    small_blocks = max(1, math.ceil(n_small / block_rows))
    large_blocks = max(1, math.ceil(n_large / block_rows))
    left = large.withColumn(
        "_lb", F.pmod(F.xxhash64(large_key), F.lit(large_blocks))
    ).withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(small_blocks - 1)).cast("array<bigint>")))
    right = small.withColumn(
        "_sb", F.pmod(F.xxhash64(small_key), F.lit(small_blocks))
    ).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(large_blocks - 1)).cast("array<bigint>")))

    names = [part.split()[0] for part in schema.split(",")]

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        return kernel(a.drop(columns=["_lb", "_sb"]), b.drop(columns=["_lb", "_sb"]))

    paired = left.groupBy("_lb", "_sb").cogroup(right.groupBy("_lb", "_sb"))
    return paired.applyInPandas(pair, schema), small_blocks == 1


def slices(batch: pd.DataFrame, width: int):
    """Parts of a batch so short that a dense matrix of ``width`` columns stays small."""
    step = max(1, CELLS_AT_ONCE // max(1, width))
    for start in range(0, len(batch), step):
        yield batch.iloc[start : start + step]


def attach_dimension(df: DataFrame, dimension: DataFrame, out: str) -> DataFrame:
    """Give each row the whole dimension as arrays of at most a block's rows.

    The dimension is cut into hash blocks of bounded size; a row is repeated per block and meets
    it in an equi-join on the block number. The blocks are broadcast if their summed size is under
    the limit, else each is copied to several salts, so that no block number is a hot key.
    """
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in dimension.columns])
    size = dimension.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(text) * 2 + 64).alias("bytes")
    ).first()
    blocks = max(1, math.ceil(size["rows"] / DIMENSION_BLOCK))
    packed = (
        dimension.withColumn("_block", F.pmod(F.xxhash64(*dimension.columns), F.lit(blocks)))
        .groupBy("_block")
        .agg(F.collect_list(F.struct(*dimension.columns)).alias(out))
    )
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    rows = df.withColumn("_block", F.explode(numbers))
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(packed), "_block").drop("_block")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    return salted.join(packed.withColumn("_salt", F.explode(salts)), ["_block", "_salt"]).drop(
        "_block", "_salt"
    )
