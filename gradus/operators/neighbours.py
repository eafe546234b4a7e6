"""Exact nearest vectors by cosine over the cells of a metric, for banks too large to broadcast.

Angles between vectors obey the triangle inequality. A bounded sample of the bank, its pivots, parts the
bank into cells: each vector belongs to the pivot at the least angle, and a cell knows how many members
it has and between which angles they lie from the pivot. A member's angle to a query is then at least
``lower_bounds`` of the query's own angle to the pivot.

A query first visits the nearest cells that hold k members together. The k-th best similarity found
there is a radius: only cells whose bound lies within it can hold anything better, and only those are
visited in a second pass. Cells and queries meet in an equi-join on the cell, so no cell that every
query rules out is read, and a cell with very many members or visitors is cut into blocks of bounded
size. Nothing is approximate: bounds are widened by the rounding of similarities and of arithmetic, and
equal similarities keep their lowest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import vectors
from gradus.session import checkpointed, stacked

#: Members that a cell should have, and the most pivots: what is sent to the tasks does not grow on.
CELL_ROWS, MAX_PIVOTS = 512, 4096
#: Rows of each side that one task compares at a time.
BLOCK_ROWS = 4096
#: What similarities may lose by rounding, and angles by arithmetic.
SIMILARITY_SLACK, ANGLE_SLACK = 2e-6, 2e-6

CELLS = "array<struct<cell:int,members:bigint,low:double,high:double>>"


def lower_bounds(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least angle from a query to any member of cells, from its angles to their pivots."""
    return np.maximum(np.maximum(angles - high, low - angles), 0.0) - ANGLE_SLACK


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def choose_pivots(bank: DataFrame, members: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Unit vectors of a sample of the bank that is the same in every run, at most ``MAX_PIVOTS``."""
    count = min(MAX_PIVOTS, max(1, math.ceil(members / cell_rows)))
    picked = (
        bank.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(count)
    )
    units = vectors.unit_rows(picked.toPandas()["embedding"])
    return units[~np.isnan(units).any(axis=1)]


def cells_of(bank: DataFrame, pivots: np.ndarray, bank_id: str) -> DataFrame:
    """The bank with each vector's ``_cell`` and ``_angle`` from its pivot; vectors of length zero,
    which have no direction, are left out. Columns: bank_id, embedding, _scope."""
    shared = bank.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            units = vectors.unit_rows(batch["embedding"]) if len(batch) else np.zeros((0, 1))
            known = ~np.isnan(units).any(axis=1)
            batch = batch[known]
            if len(batch):
                angles = _angles(units[known], shared.value)
                cell = np.argmin(angles, axis=1)
                yield batch.assign(_cell=cell.astype(np.int32), _angle=angles[np.arange(len(cell)), cell])

    types = {c: bank.schema[c].dataType.simpleString() for c in bank.columns}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return bank.mapInPandas(assign, f"{schema}, _cell int, _angle double")


def cell_bounds(celled: DataFrame) -> DataFrame:
    """(_scope, _cells): the cells of each scope, at most one per pivot, with members and angles."""
    each = celled.groupBy("_scope", "_cell").agg(
        F.count(F.lit(1)).alias("members"), F.min("_angle").alias("low"), F.max("_angle").alias("high")
    )
    cell = F.struct(F.col("_cell").alias("cell"), "members", "low", "high")
    return each.groupBy("_scope").agg(F.collect_list(cell).alias("_cells"))


def visits(queries: DataFrame, bounds: DataFrame, pivots: np.ndarray, query_id: str, k: int) -> DataFrame:
    """(query_id, embedding, _scope, _radius, _cell, _members) of the cells that a query has to visit.

    Without a ``_radius`` these are the nearest cells that hold k members together; with one, all others
    that are not ruled out by it.
    """
    shared = queries.sparkSession.sparkContext.broadcast(pivots)
    id_type = queries.schema[query_id].dataType.simpleString()
    scope_type = queries.schema["_scope"].dataType.simpleString()

    def choose(batches):
        for batch in batches:
            units = vectors.unit_rows(batch["embedding"]) if len(batch) else np.zeros((0, 1))
            rows = []
            for at in np.flatnonzero(~np.isnan(units).any(axis=1)):
                row = batch.iloc[at]
                cells = row["_cells"]
                number = np.array([c["cell"] for c in cells])
                members = np.array([c["members"] for c in cells])
                angles = _angles(units[at : at + 1], shared.value)[0][number]
                order = np.argsort(angles, kind="stable")
                before = np.cumsum(members[order]) - members[order]
                home = np.zeros(len(cells), bool)
                home[order[before < k]] = True
                radius = row["_radius"]
                if math.isnan(radius):
                    wanted = home
                else:
                    low = np.array([c["low"] for c in cells])
                    high = np.array([c["high"] for c in cells])
                    wanted = ~home & (lower_bounds(angles, low, high) <= radius)
                for c in np.flatnonzero(wanted):
                    rows.append((row[query_id], row["embedding"], row["_scope"], number[c], members[c]))
            yield pd.DataFrame(rows, columns=[query_id, "embedding", "_scope", "_cell", "_members"])

    schema = (
        f"`{query_id}` {id_type}, embedding {queries.schema['embedding'].dataType.simpleString()}, "
        f"_scope {scope_type}, _cell int, _members bigint"
    )
    known = queries.join(bounds, "_scope").withColumn("_radius", F.coalesce("_radius", F.lit(float("nan"))))
    return known.mapInPandas(choose, schema)


def compare(
    celled: DataFrame, visitors: DataFrame, query_id: str, bank_id: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, bank_id, similarity): the best k of each visited block of a cell, by (similarity, id)."""
    cell = ["_scope", "_cell"]
    met = visitors.groupBy(*cell).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("_query_blocks"),
        F.ceil(F.max("_members") / block_rows).alias("_bank_blocks"),
    )

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    banks = (
        celled.select(bank_id, "embedding", *cell)
        .join(met, cell)
        .withColumn("_b", F.pmod(F.xxhash64(bank_id), F.col("_bank_blocks")))
        .withColumn("_q", numbers("_query_blocks"))
        .drop("_query_blocks", "_bank_blocks")
    )
    asked = (
        visitors.join(met, cell)
        .withColumn("_q", F.pmod(F.xxhash64(query_id), F.col("_query_blocks")))
        .withColumn("_b", numbers("_bank_blocks"))
        .select(query_id, "embedding", *cell, "_b", "_q")
    )
    types = [df.schema[c].dataType.simpleString() for df, c in ((visitors, query_id), (celled, bank_id))]
    empty = [query_id, bank_id, "similarity"]

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in empty})
        return vectors.top_k(left, right, query_id, bank_id, k)

    keys = [*cell, "_b", "_q"]
    return (
        asked.groupBy(*keys)
        .cogroup(banks.groupBy(*keys))
        .applyInPandas(pair, f"`{query_id}` {types[0]}, `{bank_id}` {types[1]}, similarity double")
    )


def nearest(
    queries: DataFrame,
    bank: DataFrame,
    query_id: str,
    bank_id: str,
    k: int,
    members: int,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, bank_id, similarity), among them the exact k nearest of each query in its scope.

    ``queries`` and ``bank``: id, embedding, _scope; only equal scopes meet. ``members`` is the number of
    rows of the bank.
    """
    pivots = choose_pivots(bank, members, cell_rows)
    types = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (bank, bank_id))]
    if not len(pivots):
        empty = f"`{query_id}` {types[0]}, `{bank_id}` {types[1]}, similarity double"
        return bank.sparkSession.createDataFrame([], empty)
    celled = checkpointed(cells_of(bank, pivots, bank_id))
    bounds = checkpointed(cell_bounds(celled))
    start = queries.withColumn("_radius", F.lit(None).cast("double"))
    first = checkpointed(
        compare(celled, visits(start, bounds, pivots, query_id, k), query_id, bank_id, k, block_rows)
    )
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"))
    top = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    angle = F.acos(F.greatest(F.lit(-1.0), F.min("similarity") - SIMILARITY_SLACK)) + ANGLE_SLACK
    # With fewer than k members in its scope a query has visited them all.
    radius = top.groupBy(query_id).agg(F.when(F.count(F.lit(1)) == k, angle).alias("_radius"))
    more = queries.join(radius.where("_radius is not null"), query_id)
    second = compare(celled, visits(more, bounds, pivots, query_id, k), query_id, bank_id, k, block_rows)
    return stacked(first, second)
