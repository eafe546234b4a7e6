"""Connected components of links, and rows picked by id, without collecting either."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.words import unused
from gradus.session import checkpointed

#: Ids that may be broadcast to pick rows by; beyond it both sides are shuffled.
PICK_LIMIT = 500_000
#: Links that one task may take in a round of ``components``; more are dealt over all partitions.
ROUND_LINKS = 100_000


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct (u, v) stored, and their number with 128 bits of their set: equal sets, equal digests."""
    edges = checkpointed(edges)
    state = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))
    ).first()
    return _together(edges, state), tuple(state)


def _together(edges: DataFrame, state: tuple) -> DataFrame:
    return edges.coalesce(1) if state[0] <= ROUND_LINKS else edges


def _with_least(edges: DataFrame, state: tuple) -> DataFrame:
    """(u, v, m): m is the least v of each u. A window looks at one partition where it is; joins split hot nodes."""
    if state[0] <= ROUND_LINKS:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b) links; a component is named by its least node.

    Each round links every node to the least node it knows (its larger neighbours first, then its
    smaller ones) until nothing changes: the rounds grow with the logarithm of the longest path.
    Neighbours are reduced by partial aggregates and joined back, so a node with a third of all
    links is split like any skewed join key. Up to ``ROUND_LINKS`` links are one partition, so that a
    round over few links is one task and not all partitions of eight shuffles.
    """
    edges, state = _counted(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v")
        .distinct()
    )
    while True:
        # Large star: larger neighbours of a node go to the least of the node and its neighbours.
        both = _together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), state)
        large = (
            _with_least(both, state)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # Small star: a node and its smaller neighbours go to the least of these.
        before = state
        edges, state = _counted(
            _with_least(large, state)
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        if state == before:
            break
    named = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = named.select(F.col("component").alias("u"), "component").distinct()
    return named.unionByName(roots).select(F.col("u").alias("node"), "component")


def pick(df: DataFrame, column: str, ids: DataFrame, others: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``column`` is, or with ``others`` is not, in the distinct, stored ``ids``.

    Few ids are broadcast, after they were counted, so that the rows stay where they are.
    """
    name = unused(df, "picked")
    only = ids.select(F.struct(F.col(ids.columns[0]).alias("id")).alias(name))
    if only.limit(PICK_LIMIT + 1).count() <= PICK_LIMIT:
        only = F.broadcast(only)
    how = "left_anti" if others else "left_semi"
    return df.join(only, F.col(f"`{column}`") == F.col(f"{name}.id"), how)
