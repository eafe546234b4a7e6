"""Ranked search against a plain count of every document for every item."""

import math
import re
from collections import Counter

import duckdb
import pytest

from gradus.llm import ranking
from tests.llm.helpers import BASE, documents, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    terms = [(key, TERM.findall((text or "").translate(LOW))) for key, text in docs]
    n_docs = sum(bool(t) for _, t in terms)
    length = sum(len(t) for _, t in terms)
    holding = Counter(t for _, found in terms for t in set(found))
    tfs = [(key, len(found), Counter(found)) for key, found in terms if found and key is not None]
    rows = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOW)))
        scores = []
        for key, n, tf in tfs:
            m = 100 - 25 + 25 * n * n_docs // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
                for t, times in asked.items() if t in tf
            )
            if score > 0:
                scores.append((-score, key))
        rows += [(item, r + 1, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(rows)


def found(index, items, k):
    return sorted(tuple(r) for r in ranking.search(index, items, k).collect())


ITEMS = [
    (1, "committee bridge, the THE river"), (2, ""), (3, None), (4, "nowhere-to-be-found zzz"),
    (5, "word7 and word8"), (6, "Ünïcödé 日本語 text"), (7, "one two one"),
]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_POSTINGS": 40, "TASK_TERMS": 3, "ITEM_BYTES": 30}])
def test_awkward_rows(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranking, name, value)
    df = table(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    index = ranking.build_index(df)
    for k in (1, 3, 20):
        assert found(index, items, k) == plain(given, ITEMS, k)
    twice = items.unionAll(items.where("item_id = 1"))
    got = [r for r in found(index, twice, 2) if r[0] == 1]
    assert got == sorted(2 * [r for r in plain(given, ITEMS, 2) if r[0] == 1])


def test_empty_tables(spark):
    df, items = table(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    none = ranking.build_index(df.limit(0))
    assert ranking.search(none, items).count() == 0
    assert ranking.search(ranking.build_index(df), items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert ranking.search(ranking.build_index(blank), items).count() == 0


def test_names_and_types(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "`the id` string, score string")
    items = spark.createDataFrame([("q", "x")], "docs string, m string")
    index = ranking.build_index(df, "the id", "score")
    got = ranking.search(index, items, 5, "docs", "m", "the id").collect()
    assert [(r.docs, r.rank, r["the id"]) for r in got] == [("q", 1, "a"), ("q", 2, "b")]


def test_query_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(docs, items, 20)
    got = ranking.op12_ranked_search(spark, BASE)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    assert sorted(duck.execute(ranking.SEARCH_SQL).fetchall()) == want


def test_bounds_skip_strata(spark):
    """Strata that cannot reach the best scores are not scored, and the result stays whole."""
    docs = [(k, " ".join(["rare"] * (1 if k > 5 else 9) + ["filler"] * (10 * (k % 40) + 1))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = ranking.build_index(df)
    items = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    assert found(index, items, 3) == plain(docs, [(1, "rare")], 3)

    visited = []

    class Counted(ranking._Stratum):
        def scores(self, terms, weights):
            visited.append(self.m)
            return super().scores(terms, weights)

    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [k for k, _ in docs], "text": [t.encode() for _, t in docs]})
    (block,) = ranking.blocks_of([batch], index.documents, index.length)
    rows = [Counted(row, pa.array([b"rare"], pa.binary())) for row in ranking._rows(block)]
    best = [[]]
    ranking.best_of(rows, ranking._Items({b"rare": 0}, [np.array([0])], [np.array([7])]), best, 3)
    assert len(best[0]) == 3 and len(visited) < len(rows) / 3
