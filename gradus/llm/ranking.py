r"""Ranked lexical search over a length-stratified index.

The score of a document for an item is a sum over the item's terms of ``w * impact``, where the term's
weight w falls with the number of documents that hold it, and impact = 10^9 tf div (1000 tf + 12 m)
depends on the occurrences tf and on the document's length alone, by its normaliser m. Documents of
equal m form a stratum, within which equal tf means equal impact. So a task that reads documents indexes
them in blocks of ``BLOCK_POSTINGS``, a row per stratum: its document ids, and for each of its terms the
documents by tf. Nothing is sampled: every document with a term is in one stratum, all its terms posted.

A search works out the impacts of a stratum once per tf. The impact of a term's highest tf, times the
weight, summed over an item's terms, bounds all scores of that stratum: each item visits the strata in
descending order of their bounds and stops where the bound falls below its k-th best score. Scores are
whole numbers and ties go to the lower id, so a bound equal to the k-th score is still visited. Every
task keeps its k best for each item from block to block; those are ranked in the end, k rows for each
item and task. The index is parted by documents, so neither texts nor postings are shuffled, and a lost
executor costs its own blocks.

Items are searched in blocks of ``ITEM_BYTES`` of their texts, so that what is sent to the tasks is
bounded. The documents are read once for the counts (terms, documents, length), which are stored, and
once for each block of items.

Terms are the maximal stretches of digits, A-Z, a-z and characters beyond ASCII, A-Z lower-cased. Null
and empty texts have none, count nowhere and are never returned. Documents without an id count in the
statistics but cannot be named, so they are not returned. Rows of equal id are ranked one by one, each
row of equal item ids gets its own ranking. Empty tables give no rows. Long texts are looked at whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import slices
from gradus.session import scratch_folder

#: Share of the normaliser that follows the length, in hundredths, and scales of score and weight.
SHARE, SCALE, FACTOR, WEIGHT = 25, 1_000_000_000, 12, 1000
#: Postings of the documents that one block of strata holds.
BLOCK_POSTINGS = 400_000
#: Distinct terms that a task counts before it hands them on.
TASK_TERMS = 200_000
#: Bytes of item texts that are sent to the tasks at once.
ITEM_BYTES = 100_000

_TERM = [48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)]
_FOLD = bytes((b + 32 if 65 <= b < 91 else b) if _TERM[b] else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return (text or b"").translate(_FOLD).split()


def normaliser(n: int, documents: int, length: int) -> int:
    return 100 - SHARE + SHARE * n * documents // length


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf, m: int):
    return SCALE * tf // (1000 * tf + FACTOR * m)


@dataclass
class Index:
    """The documents (id, text) that a search indexes, ``terms`` (term, holding), the number of
    ``documents`` with a term and the ``length`` of all."""

    docs: DataFrame
    terms: DataFrame
    documents: int
    length: int


def statistics(docs: DataFrame) -> DataFrame:
    """(term, holding, length): documents that hold each term; the row of no term has the number of
    documents with a term and the terms of all of them."""

    def batch(counts: Counter, documents: int, length: int) -> pa.RecordBatch:
        rows = [
            pa.array([None, *counts], pa.binary()),
            pa.array([documents, *counts.values()], pa.int64()),
            pa.array([length] + [0] * len(counts), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(rows, names=["term", "holding", "length"])

    def tasks(batches):
        counts, documents, length = Counter(), 0, 0
        for given in batches:
            for part in slices(given):
                for text in part.column(1).to_pylist():
                    if found := terms_of(text):
                        documents += 1
                        length += len(found)
                        counts.update(set(found))
                if len(counts) > TASK_TERMS:
                    yield batch(counts, documents, length)
                    counts, documents, length = Counter(), 0, 0
        yield batch(counts, documents, length)

    found = docs.mapInArrow(tasks, "term binary, holding bigint, length bigint")
    return found.groupBy("term").agg(F.sum("holding").alias("holding"), F.sum("length").alias("length"))


def _lists(values: np.ndarray, cuts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


class _Block:
    """Postings of some documents, and the strata made of them.

    A stratum is (m, docs, terms, groups, tfs, counts, members): its k-th term has groups[k] values of tf,
    each of these counts[..] members, which are places in docs.
    """

    def __init__(self):
        self.docs, self.m, self.sizes = [], [], []
        self.numbers: dict[bytes, int] = {}
        self.terms, self.tfs = [], []

    def add(self, doc, found: list[bytes], m: int) -> None:
        counts = Counter(found)
        number = self.numbers
        self.terms.extend([number.setdefault(t, len(number)) for t in counts])
        self.tfs.extend(counts.values())
        self.docs.append(doc)
        self.m.append(m)
        self.sizes.append(len(counts))

    def strata(self, id_type) -> pa.RecordBatch:
        m = np.array(self.m, np.int64)
        by_m = np.argsort(m, kind="stable")
        place = np.empty(len(m), np.int64)
        place[by_m] = np.arange(len(m))
        doc = np.repeat(place, self.sizes)
        heads = np.flatnonzero(np.append(True, np.diff(m[by_m]) != 0))
        stratum = np.searchsorted(heads, doc, side="right") - 1
        term, tf = np.array(self.terms, np.int64), np.array(self.tfs, np.int64)
        order = np.lexsort((doc, tf, stratum * len(self.numbers) + term))
        doc, stratum, term, tf = doc[order], stratum[order], term[order], tf[order]
        new_term = np.append(True, (np.diff(term) != 0) | (np.diff(stratum) != 0))
        new_group = new_term | np.append(True, np.diff(tf) != 0)
        group, first = np.flatnonzero(new_group), np.flatnonzero(new_term)
        edges = np.arange(len(heads) + 1)
        cut_terms = np.searchsorted(stratum[first], edges)
        cut_groups = np.searchsorted(stratum[group], edges)
        names = pa.array(list(self.numbers), pa.binary())
        columns = [
            pa.array(m[by_m][heads]),
            pa.ListArray.from_arrays(
                pa.array(np.append(heads, len(m)).astype(np.int32)),
                pa.array([self.docs[k] for k in by_m.tolist()], id_type),
            ),
            pa.ListArray.from_arrays(pa.array(cut_terms.astype(np.int32)), names.take(pa.array(term[first]))),
            _lists(np.diff(np.append(np.searchsorted(group, first), len(group))), cut_terms, pa.int32()),
            _lists(tf[group], cut_groups, pa.int32()),
            _lists(np.diff(np.append(group, len(doc))), cut_groups, pa.int32()),
            _lists(doc - heads[stratum], np.searchsorted(stratum, edges), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(
            columns, names=["m", "docs", "terms", "groups", "tfs", "counts", "members"]
        )


def build_index(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """What a search needs to index the documents; the counts are stored in the shared folder."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    folder = scratch_folder(spark)
    statistics(docs).write.parquet(folder)
    terms = spark.read.parquet(folder)
    whole = terms.where("term IS NULL").collect()
    documents, length = (whole[0]["holding"], whole[0]["length"]) if whole else (0, 0)
    return Index(docs, terms.where("term IS NOT NULL"), documents, length)


def blocks_of(batches, documents: int, length: int):
    """The strata of blocks of documents, from batches of (id, text)."""
    block, id_type = _Block(), None
    for given in batches:
        id_type = given.column(0).type
        for part in slices(given):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = terms_of(text)
                if found and doc is not None:
                    block.add(doc, found, normaliser(len(found), documents, length))
                if len(block.terms) >= BLOCK_POSTINGS:
                    yield block.strata(id_type)
                    block = _Block()
    if block.terms:
        yield block.strata(id_type)


@dataclass
class _Items:
    """Items of a block: the number of each term, and per item its terms' numbers and weights."""

    numbers: dict[bytes, int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]


class _Stratum:
    """The postings of the items' terms in one stratum, with an impact for each tf."""

    def __init__(self, row: dict, wanted: pa.Array):
        self.docs, self.m = row["docs"], row["m"]
        number = pc.index_in(row["terms"], value_set=wanted)
        held = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        cut = np.concatenate([[0], np.cumsum(row["groups"])])
        impacts = impact(row["tfs"].astype(np.int64), self.m)
        starts = np.concatenate([[0], np.cumsum(row["counts"])])
        #: Per term of the items: whether it is here, its highest impact, its stretch of postings.
        self.top = np.zeros(len(wanted), np.int64)
        self.first = np.zeros(len(wanted), np.int64)
        self.size = np.zeros(len(wanted), np.int64)
        at = number.take(pa.array(held)).to_numpy().astype(np.int64)
        self.top[at] = impacts[cut[held + 1] - 1]
        self.first[at] = starts[cut[held]]
        self.size[at] = starts[cut[held + 1]] - starts[cut[held]]
        self.members = row["members"]
        self.impacts = np.repeat(impacts, row["counts"])

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.size[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + size, size)
        found = np.zeros(len(self.docs), np.int64)
        np.add.at(found, self.members[at], self.impacts[at] * np.repeat(weights, size))
        return found


def _rows(batch) -> list[dict]:
    """Strata of an Arrow batch: numbers as numpy views, terms as an Arrow array."""
    rows = []
    columns = {c: batch.column(c) for c in batch.schema.names}
    for k in range(batch.num_rows):
        row = {"m": columns["m"][k].as_py(), "docs": columns["docs"][k].values, "terms": columns["terms"][k].values}
        for c in ("groups", "tfs", "counts", "members"):
            row[c] = columns[c][k].values.to_numpy()
        rows.append(row)
    return rows


def best_of(strata: list[_Stratum], items: _Items, best: list[list], k: int) -> None:
    """Put the documents of some strata into ``best``, each item's k lowest (-score, id)."""
    tops = np.stack([s.top for s in strata])
    for item, (terms, weights) in enumerate(zip(items.terms, items.weights)):
        if not len(terms):
            continue
        bounds = tops[:, terms] @ weights
        found = best[item]
        for place in np.argsort(-bounds, kind="stable").tolist():
            bound = int(bounds[place])
            least = -found[-1][0] if len(found) == k else 1
            if bound < max(least, 1):
                break
            stratum = strata[place]
            scores = stratum.scores(terms, weights)
            chosen = np.flatnonzero(scores >= least)
            if len(chosen):
                ids = stratum.docs.take(pa.array(chosen)).to_pylist()
                more = zip((-scores[chosen]).tolist(), ids)
                found = best[item] = heapq.nsmallest(k, [*found, *more])


def _search(index: Index, rows: list, k: int, id_sql: str) -> DataFrame:
    """(item, found): each task's best documents for the items of a block."""
    spark, documents, length = index.docs.sparkSession, index.documents, index.length
    counts = [Counter(terms_of(r["text"])) for r in rows]
    numbers = {t: n for n, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
    asked = spark.createDataFrame([(bytearray(t),) for t in numbers] or [], "term binary")
    held = index.terms.join(F.broadcast(asked), "term").select("term", "holding").collect()
    weights = {bytes(r["term"]): weight(index.documents, r["holding"]) for r in held}
    kept = [{t: n * weights[t] for t, n in c.items() if weights.get(t)} for c in counts]
    items = _Items(
        numbers,
        [np.array([numbers[t] for t in c], np.int64) for c in kept],
        [np.array(list(c.values()), np.int64) for c in kept],
    )
    shared = spark.sparkContext.broadcast(items)

    def tasks(batches):
        given = shared.value
        wanted = pa.array(list(given.numbers), pa.binary())
        best: list[list] = [[] for _ in given.terms]
        id_type = None
        for block in blocks_of(batches, documents, length):
            id_type = block.schema.field("docs").type.value_type
            best_of([_Stratum(row, wanted) for row in _rows(block)], given, best, k)
        met = [n for n, found in enumerate(best) if found]
        if met:
            flat = [pair for n in met for pair in best[n]]
            cuts = np.concatenate([[0], np.cumsum([len(best[n]) for n in met])]).astype(np.int32)
            scores = pa.array([-s for s, _ in flat], pa.int64())
            pairs = pa.StructArray.from_arrays([scores, pa.array([d for _, d in flat], id_type)], ["score", "id"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(met, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pairs)],
                names=["item", "found"],
            )

    return index.docs.mapInArrow(tasks, f"item int, found array<struct<score:bigint,id:{id_sql}>>")


def search(
    index: Index,
    items: DataFrame,
    k: int = 20,
    item_column: str = "item_id",
    text_column: str = "text",
    doc_column: str = "doc_id",
) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score for each item, fewer if fewer score.

    Items are dealt into blocks by a hash of theirs, as many as their summed size asks for.
    """
    spark = items.sparkSession
    given = items.select(
        F.col(f"`{item_column}`").alias("item_id"), F.col(f"`{text_column}`").cast("binary").alias("text")
    )
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    id_sql = index.docs.schema["id"].dataType.simpleString()
    parts = []
    for number in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        names = spark.createDataFrame(
            [(n, r["item_id"]) for n, r in enumerate(rows)], f"item int, item_id {given.schema['item_id'].dataType.simpleString()}"
        )
        best = Window.partitionBy("item").orderBy(F.desc("f.score"), "f.id")
        found = _search(index, rows, k, id_sql).select("item", F.explode("found").alias("f"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(
            ranked.join(F.broadcast(names), "item").select(
                F.col("item_id").alias(item_column), "rank", F.col("f.id").alias(doc_column),
                F.col("f.score").alias("score"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS_SQL = (
    f"regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SEARCH_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS place, doc_id, {_TERMS_SQL} AS terms FROM documents
), held AS (
    SELECT place, doc_id, unnest(terms) AS term, len(terms) AS n FROM docs
), whole AS (
    SELECT count(*) AS documents, sum(len(terms))::BIGINT AS length FROM docs WHERE len(terms) > 0
), postings AS (
    SELECT place, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL
), weights AS (
    SELECT term,
        CAST(floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, whole GROUP BY term
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL
), scores AS (
    SELECT item_id, place, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), whole
    GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scores WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, base: str) -> DataFrame:
    """The 20 documents of highest score for each benchmark item, over the index of all documents."""
    index = build_index(read(spark, base, "documents"))
    return search(index, read(spark, base, "benchmark"), k=20)
