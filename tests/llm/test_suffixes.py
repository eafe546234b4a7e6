"""Repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gradus.llm import suffixes
from tests.llm.helpers import BASE, documents, table


def plain(texts, span):
    """Per text (removed bytes, stretches, kept bytes)."""
    met = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - span + 1):
            if met[t[i : i + span]] > 1:
                start = max(i, end)
                gone[start : i + span] = b"\1" * (i + span - start)
                end = i + span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), runs, kept))
    return out


def found(df, span, gram, id_column="doc_id"):
    rows = suffixes.without_repeats(df, id_column, span=span, gram=gram).collect()
    return sorted(
        (r[id_column], r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept))
        for r in rows
    )


def made(draw, n=40, size=900):
    letters = b"abcdefgh "
    noise = lambda k: bytes(draw.choice(letters) for _ in range(k))
    shared = [noise(draw.randrange(20, 400)) for _ in range(4)] + [b"ab" * 150, b"x" * 200]
    texts = []
    for _ in range(n):
        parts = []
        while sum(map(len, parts)) < draw.randrange(size):
            kind = draw.randrange(4)
            parts.append(draw.choice(shared) if kind else noise(draw.randrange(120)))
            if kind == 3:
                cut = bytearray(parts[-1])
                cut[draw.randrange(len(cut))] = draw.choice(letters)
                parts[-1] = bytes(cut)
        texts.append(b"".join(parts))
    return texts + texts[:2] + [b""]


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "STEP": 4}, {"HOT": 1, "STEP": 3}, {"PIECE": 97, "BLOCK_BYTES": 500, "BUCKET_WINDOWS": 7}])
def test_made_texts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    texts = made(random.Random(4))
    for span, gram in ((40, 12), (64, 20)):
        df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
        want = [(k, len(t), *w) for k, (t, w) in enumerate(zip(texts, plain(texts, span)))]
        assert found(df, span, gram) == want


def test_order_of_windows(monkeypatch):
    """The full suffix order, across residues too."""
    draw = random.Random(7)
    monkeypatch.setattr(suffixes, "BUCKET_WINDOWS", 50)
    for text in (b"a" * 300, b"ab" * 170, b"abc" * 90 + b"abd" + b"abc" * 60, bytes(draw.choice(b"ab") for _ in range(500))):
        span = 60
        data = np.frombuffer(text + bytes(4 * span + suffixes.MODULUS * 70), np.uint8)
        windows = np.arange(len(text) - span + 1)
        order = [int(k) for part, _ in suffixes.window_order(data, windows, span) for k in part]
        assert sorted(order) == windows.tolist()
        whole = data.tobytes()
        heads = [whole[k : k + span] for k in order]
        assert heads == sorted(heads)


def test_cover():
    differences = {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.MODULUS))


def test_query(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in documents(spark).collect()]
    got = {r.doc_id: r for r in suffixes.op13_repeated_bytes(spark, BASE).collect()}
    assert len(got) == len(docs)
    some = 0
    for (key, text), (removed, runs, kept) in zip(docs, plain([t for _, t in docs], 400)):
        r = got[key]
        some += removed > 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), removed, runs)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert some > 10


def test_awkward_rows(spark):
    df = table(spark)
    texts = [(r.text or "").encode() for r in df.select("text").collect()]
    for span, gram in ((30, 10), (400, 112)):
        rows = suffixes.without_repeats(df, span=span, gram=gram).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r._kept)) for r in rows]
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        want = [(k, len(t), *w) for k, t, w in zip(ids, texts, plain(texts, span))]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert set(df.columns) - {"text"} <= set(rows[0].asDict())
    assert suffixes.without_repeats(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert found(blank, 30, 10) == [(1, 0, 0, 0, b""), (2, 0, 0, 0, b"")]


def test_broad_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_HELD", 0)
    texts = made(random.Random(9), n=12)
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    assert found(df, 40, 12) == [(k, len(t), *w) for k, (t, w) in enumerate(zip(texts, plain(texts, 40)))]


def test_buckets_stay_whole_after_a_join_that_turns_into_a_broadcast(spark):
    """Spark drops a repartition by the key of a join below it, whose shuffle it may then read in place."""
    draw = random.Random(5)
    noise = lambda n: bytes(draw.choice(b"abcdefgh") for _ in range(n))
    shared = [noise(60) for _ in range(80)]
    texts = [noise(3) + shared[k % 80] + noise(20) for k in range(160)]
    rows = [(k % 5, k, len(t) - 39, 20, bytearray(t)) for k, t in enumerate(texts)]
    names = (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.coalescePartitions.enabled",
    )
    before = {name: spark.conf.get(name, None) for name in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "10MB")
    spark.conf.set(names[2], "false")
    try:
        many = spark.createDataFrame(rows, "anchor bigint, class bigint, width int, off int, text binary")
        many = many.withColumnRenamed("anchor", "bucket").repartition(8).localCheckpoint()
        few = spark.createDataFrame([(k,) for k in range(5)], "bucket bigint").localCheckpoint()
        joined = many.join(few, "bucket").withColumnRenamed("bucket", "anchor")
        found = suffixes.sorted_buckets(joined, 40)
        got = found.collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    met = Counter((k % 5, t[w : w + 40]) for k, t in enumerate(texts) for w in range(len(t) - 39))
    want = {(k, w) for k, t in enumerate(texts) for w in range(len(t) - 39) if met[k % 5, t[w : w + 40]] > 1}
    assert {(r["class"], w) for r in got for w in range(r["first"], r["last"] + 1)} >= want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Initial Plan")[0]
    assert len(want) > 1000
