"""Periodic runs against a search over all periods and starts."""

import hashlib
import random
import zlib

import pytest

from gradus.llm import runs
from tests.llm.helpers import BASE, WORD, documents, table


def plain_runs(words, least, times):
    """Every stretch that keeps a period as far as it goes, of each period that no divisor makes."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j
    return sorted((i, length, q) for (i, length), q in found.items())


def plain_collapsed(words, found):
    gone = {k for i, length, q in found for k in range(i + q, i + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def made(draw):
    kind = draw.randrange(4)
    if kind == 0:
        return [draw.choice("ab") for _ in range(draw.randrange(70))]
    if kind == 1:
        p = draw.randrange(1, 9)
        part = [draw.choice("abc") for _ in range(p)]
        return [draw.choice("abc") for _ in range(draw.randrange(6))] + (part * 20)[: draw.randrange(60)] + ["z"] * draw.randrange(3)
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(draw.randrange(8)):
            a, b = b, b + a
        return b[:90]
    part = [draw.choice("ab") for _ in range(5)]
    return (part * 9 + ["x"]) * draw.randrange(1, 4) + ["y"] * draw.randrange(40)


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (10, 3)])
def test_runs_of_made_texts(least, times):
    draw = random.Random(11)
    for _ in range(60):
        texts = [[w.encode() for w in made(draw)] for _ in range(draw.randrange(12))]
        got = runs.find_runs(texts, least, times)
        for words, found in zip(texts, got):
            want = plain_runs(words, least, times)
            assert found == want
            assert runs.collapsed(words, found) == plain_collapsed(words, want)


def test_one_word_and_one_period_very_often():
    words = [b"again"] * 300_000
    assert runs.find_runs([words]) == [[(0, 300_000, 1)]]
    part = [f"w{k}".encode() for k in range(700)]
    assert runs.find_runs([[b"x"], part * 300 + part[:5]]) == [[], [(0, 210_005, 700)]]


def edited(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query(spark):
    known = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    got = runs.op11_periodic_runs(spark, BASE).collect()
    assert {r.doc_id for r in got} == set(known) and len(got) == len(known)
    with_runs = 0
    for r in got:
        words = edited(r.doc_id, WORD.findall(known[r.doc_id]))
        found = plain_runs(words, 24, 3) if len(words) < 3000 else None
        if found is None:
            found = [x for x in runs.find_runs([[w.encode() for w in words]])[0]]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        with_runs += bool(found)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{i},{length},{q}\n" for i, length, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        left = " ".join(plain_collapsed(words, found))
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert with_runs > 10


def test_awkward_rows(spark):
    df = table(spark)
    got = runs.periodic_runs(df).collect()
    assert len(got) == df.count()
    assert set(df.columns) - {"text"} <= set(got[0].asDict())
    for r, text in zip(got, [r.text for r in df.collect()]):
        words = WORD.findall(text or "")
        assert r.n_words == len(words)
        if not r.runs:
            assert r.collapsed == " ".join(words)
    assert runs.periodic_runs(df.limit(0)).count() == 0
    named = df.withColumnRenamed("text", "runs").withColumnRenamed("doc_id", "a.b")
    assert runs.periodic_runs(named, "a.b", "runs").count() == df.count()
