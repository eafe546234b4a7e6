"""Exact neighbours over metric cells against brute force, and the cells that are never visited."""

import numpy as np
import pytest
from conftest import rows

from gradus.operators import neighbours, retrieval
from tools.check import compare, connect

VECTORS = "id long, embedding array<double>, scope string"


def brute(queries, bank, k, scoped):
    out = []
    for qid, qv, qs in queries:
        if qv is None or not np.any(qv):
            continue
        scores = []
        for bid, bv, bs in bank:
            if bv is None or not np.any(bv) or (scoped and (qs is None or qs != bs)):
                continue
            a, b = np.array(qv), np.array(bv)
            cosine = round(float(a / np.linalg.norm(a) @ (b / np.linalg.norm(b))), 6) + 0.0
            scores.append((-cosine, bid))
        out += [(qid, bid, -s, r + 1) for r, (s, bid) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def clusters(draw, count, members, width=6, spread=0.02):
    centres = draw.normal(size=(count, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return [(c + spread * draw.normal(size=width)).tolist() for c in centres for _ in range(members)]


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(5)
    vectors = clusters(draw, 40, 12)
    bank = [(k, v, "ab"[k % 2]) for k, v in enumerate(vectors)]
    bank += [(2000 + k, vectors[0], "a") for k in range(40)]  # one point a great many times
    bank += [(3000, [0.0] * 6, "a"), (3001, None, "a"), (3002, vectors[5], None)]
    queries = [(k, (np.array(vectors[7 * k]) + 0.01 * draw.normal(size=6)).tolist(), "ab"[k % 2]) for k in range(60)]
    queries += [(100, vectors[0], "a"), (101, [0.0] * 6, "a"), (102, None, "b"), (103, vectors[3], None), (104, vectors[1], "c")]
    return queries, bank, spark.createDataFrame(queries, VECTORS), spark.createDataFrame(bank, VECTORS).withColumnRenamed("id", "bid")


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("k, limits", [(1, {}), (4, {"cell_rows": 20, "block_rows": 7}), (50, {"cell_rows": 5})])
def test_equals_brute_force(tables, scoped, k, limits):
    queries, bank, q, b = tables
    scopes = {"query_scope": "scope", "bank_scope": "scope"} if scoped else {}
    got = retrieval.vector_top_k(q, b, "id", "bid", k, broadcast_bytes=0, **scopes, **limits)
    assert rows(got, "id", "bid", "similarity", "rank") == brute(queries, bank, k, scoped)


def test_cells_ruled_out_are_not_visited(spark, tables):
    queries, bank, q, b = tables
    known = b.where("embedding is not null").selectExpr("bid", "embedding", "0 AS _scope")
    pivots = neighbours.choose_pivots(known, known.count(), cell_rows=10)
    celled = neighbours.cells_of(known, pivots, "bid")
    bounds = neighbours.cell_bounds(celled)
    cells = bounds.selectExpr("size(_cells) AS n").first()["n"]
    asked = q.where("embedding is not null").selectExpr("id", "embedding", "0 AS _scope")
    home = neighbours.visits(asked.selectExpr("*", "CAST(NULL AS DOUBLE) AS _radius"), bounds, pivots, "id", 1)
    nearest = neighbours.compare(celled, home, "id", "bid", 1)
    radius = nearest.groupBy("id").agg({"similarity": "max"}).selectExpr(
        "id", f"acos(greatest(-1D, `max(similarity)` - {neighbours.SIMILARITY_SLACK})) AS _radius"
    )
    more = neighbours.visits(asked.join(radius, "id"), bounds, pivots, "id", 1)
    met = [v for _, v, _ in queries if v is not None and np.any(v)]
    visited = home.count() + more.count()
    assert cells > 30 and visited < len(met) * cells / 4
    # No cell holds a member nearer than the bound says.
    units = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in bank if v is not None and np.any(v)])
    for cell in bounds.first()["_cells"]:
        mine = [r for r in celled.where(f"_cell = {cell['cell']}").collect()][:3]
        for query in met[:5]:
            unit = np.array(query) / np.linalg.norm(query)
            angle = np.arccos(np.clip(unit @ pivots[cell["cell"]], -1, 1))
            bound = neighbours.lower_bounds(angle, cell["low"], cell["high"])
            for r in mine:
                v = np.array(r["embedding"])
                assert bound <= np.arccos(np.clip(unit @ (v / np.linalg.norm(v)), -1, 1))
    assert len(units)


def test_empty_sides(spark, tables):
    _, _, q, b = tables
    for left, right in ((q.limit(0), b), (q, b.limit(0)), (q, b.where("bid IN (3000, 3001)"))):
        assert retrieval.vector_top_k(left, right, "id", "bid", 3, broadcast_bytes=0).count() == 0


BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["active_chunk_search", "anchor_search", "novelty_detection"])
def test_registered_searches_without_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    text, ok = compare(spark, connect(BASE), BASE, name)
    assert ok, text
