"""Periodic runs of words by Kruskal over descending common prefixes.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times``
periods long, that neither neighbour continues. Where a run starts at i, the suffixes at i and i + q
share exactly its length less q words, and no suffix between them shares as many. So the suffixes of a
document are sorted, neighbours in that order are the edges of a tree weighted by their common prefix,
and the edges are taken in descending order: each unites two classes of suffixes in a union-find whose
classes keep their positions in order. Two positions that become adjacent in a class at common prefix
l, at a distance d of at most l / (times - 1), seed a run of l + d words and period d; it is kept where
the word before does not continue it. (Were the period d not the smallest, positions between the two
would have joined their class before.)

Suffixes are sorted by doubling, many documents at once, and only as far as they are not yet unique.
Common prefixes below the least that a run can have (16 words for 24 words and 3 periods) seed nothing,
so only suffixes that share as many words with another one of their document reach the union-find.
Words are compared by exact numbers, not by hashes. Smaller classes are put into larger ones.

A null or empty text has no words and no runs. Whole texts count, however long: a document's words are
held by one task, as numbers. Repeated rows and equal ids are looked at one by one, an empty table gives
no rows, and other columns pass on whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import slices, unused

LEAST, TIMES = 24, 3
#: Words that are sorted at once; a longer document is sorted alone.
BLOCK_WORDS = 200_000

Edit = Callable[[object, list[bytes]], list[bytes]]


def least_prefix(least: int = LEAST, times: int = TIMES) -> int:
    """The shortest common prefix of the suffixes one period apart at the start of any run."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): suffixes of ``x`` sorted, and per place in that order whether the suffix shares
    ``depth`` numbers, a power of two, with the one before it.

    A suffix's rank is the first place of its group of suffixes that are equal so far; groups are
    sorted by the rank of what follows until each suffix is alone.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    start = np.ones(n, bool)
    start[1:] = x[order[1:]] != x[order[:-1]]
    heads = np.flatnonzero(start)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[n] = -1
    same = 1
    tied = np.zeros(n, bool)
    left = np.flatnonzero(~(start & np.append(start[1:], True)))
    if 2 * same > depth:
        tied[left] = ~start[left]
        depth = 0
    while len(left):
        at = order[left]
        key = rank[at] * (n + 1) + rank[np.minimum(at + same, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[left] = at
        start = np.ones(len(at), bool)
        start[1:] = key[1:] != key[:-1]
        # Places of one group lie side by side, in ``left`` as in ``order``.
        heads = np.flatnonzero(start)
        rank[at] = np.repeat(left[heads], np.diff(np.append(heads, len(at))))
        same *= 2
        if depth and 2 * same > depth:
            tied[left] = ~start
            depth = 0
        left = left[~(start & np.append(start[1:], True))]
    return order, tied


def common_prefixes(x: list[int], order: np.ndarray, tied: np.ndarray, known: int) -> list[tuple[int, int, int]]:
    """(length, a, b) of neighbours in suffix order that share ``known`` numbers at least.

    Positions are walked in their own order, so that each starts from what its predecessor shared.
    """
    places = np.flatnonzero(tied)
    first, second = order[places - 1], order[places]
    by = np.argsort(second)
    found = []
    last, shared = -2, 0
    for a, b in zip(first[by].tolist(), second[by].tolist()):
        shared = max(shared - 1, known) if b == last + 1 else known
        while x[a + shared] == x[b + shared]:
            shared += 1
        found.append((shared, a, b))
        last = b
    return found


def seeds(edges: list[tuple[int, int, int]], x: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, from edges taken by descending common prefix."""
    edges.sort(reverse=True)
    parent: dict[int, int] = {}
    classes: dict[int, list[int]] = {}
    runs = []

    def root(k: int) -> int:
        top = k
        while (up := parent.get(top, top)) != top:
            top = up
        while k != top:
            parent[k], k = top, parent.get(k, k)
        return top

    def adjacent(a: int, b: int, shared: int) -> None:
        d = b - a
        if shared >= (times - 1) * d and shared + d >= least and x[a - 1] != x[b - 1]:
            runs.append((a, shared + d, d))

    for shared, a, b in edges:
        a, b = root(a), root(b)
        large = classes.pop(a, None) or [a]
        small = classes.pop(b, None) or [b]
        if len(small) > len(large):
            a, b, large, small = b, a, small, large
        parent[b] = a
        classes[a] = large
        for k in small:
            insort(large, k)
        own = set(small)
        for k in small:
            place = bisect_left(large, k)
            if place and (other := large[place - 1]) not in own:
                adjacent(other, k, shared)
            if place + 1 < len(large) and (other := large[place + 1]) not in own:
                adjacent(k, other, shared)
    return runs


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of all runs of each list of words, by start, then period."""
    known = least_prefix(least, times)
    flat = [w for words in texts for w in words]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(flat) < least:
        return found
    numbers = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    sizes = np.array([len(words) for words in texts])
    ends = np.cumsum(sizes)
    # Words of different documents are different numbers.
    x = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    x += np.repeat(np.arange(len(texts)) * len(numbers), sizes)
    depth = 1 << (known.bit_length() - 1)
    order, tied = suffix_order(x, depth)
    if not tied.any():
        return found
    listed = x.tolist() + [-1]
    edges = [e for e in common_prefixes(listed, order, tied, depth) if e[0] >= known]
    runs = seeds(edges, listed, least, times)
    if runs:
        text_of = np.searchsorted(ends, [r[0] for r in runs], side="right").tolist()
        for (start, length, period), k in sorted(zip(runs, text_of), key=lambda r: (r[0][0], r[0][2])):
            found[k].append((start - int(ends[k] - sizes[k]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _parts(batch, size: int):
    """Rows of a batch in stretches of about ``size`` words at most, as (rows, words of each)."""
    for part in slices(batch):
        held, first, total = [], 0, 0
        for k, text in enumerate(part.column(1).to_pylist()):
            words = (text or b"").split()
            if held and total + len(words) > size:
                yield part.slice(first, len(held)), held
                held, first, total = [], k, 0
            held.append(words)
            total += len(words)
        if held:
            yield part.slice(first, len(held)), held


def periodic_runs(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    edit: Edit | None = None,
) -> DataFrame:
    """``df`` with ``runs``, the array of (start, length, period), ``n_words`` and ``collapsed``, the
    words that no run repeats, joined by one space, in place of the text. Rows are not shuffled.

    Words lie between blanks and ASCII control spaces. ``edit`` gets the id and the words of a text
    and gives the words to look at. Outputs named like other columns get underscores in front.
    """
    text, names = unused(df, "words_of"), [unused(df, c) for c in ("n_words", "runs", "collapsed")]
    others = [c for c in df.columns if c != text_column]
    whole = df.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("binary").alias(text),
        F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("_row"),
    )
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def tasks(batches):
        for batch in batches:
            for part, texts in _parts(batch, BLOCK_WORDS):
                if edit:
                    texts = [edit(k, words) for k, words in zip(part.column(0).to_pylist(), texts)]
                runs = find_runs(texts, least, times)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(texts, runs)]
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2),
                        pa.array([len(w) for w in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), values),
                        pa.array(left, pa.binary()),
                    ],
                    names=["_row", "n", "runs", "left"],
                )

    row_type = whole.schema["_row"].dataType.simpleString()
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    found = whole.mapInArrow(tasks, f"_row {row_type}, n bigint, runs {run_type}, left binary")
    return found.select(
        *(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(others)),
        F.col("n").alias(names[0]), F.col("runs").alias(names[1]),
        F.col("left").cast("string").alias(names[2]),
    )


def strongest(runs):
    """The run of greatest length / period of an array of runs; ties by least start, then period."""
    better = (
        "CASE WHEN r.length * b.period > b.length * r.period THEN true"
        " WHEN r.length * b.period < b.length * r.period THEN false"
        " ELSE (r.start, r.period) < (b.start, b.period) END"
    )
    return F.expr(f"aggregate({runs}, element_at({runs}, 1), (b, r) -> IF({better}, r, b))")


def repeated_tails(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats one period of them, for the ids that the query sets."""
    n = len(words)
    if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, base: str) -> DataFrame:
    """Every document's runs after the set edit: their number, the strongest one, digests of all runs
    and of the words left."""
    docs = read(spark, base, "documents").select("doc_id", "text")
    found = periodic_runs(docs, edit=repeated_tails)
    listed = F.expr("transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n'))")
    return found.withColumn("best", F.when(F.size("runs") > 0, strongest("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
