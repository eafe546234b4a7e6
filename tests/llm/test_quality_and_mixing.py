from collections import Counter

import duckdb
import pytest

from gradus.llm import mixing, quality
from tests.llm.helpers import BASE, WORD, documents, table, texts


def measured(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, twice, len(repeated), failed


def estimate(patterns, rounds=quality.ROUNDS):
    """Expectation maximisation in plain Python; patterns: votes -> count."""
    size = quality.N_RULES
    good, yes, no = quality.START_GOOD, [quality.START_YES] * size, [quality.START_NO] * size

    def posterior(votes):
        right, wrong = good, 1 - good
        for r, v in enumerate(votes):
            if v:
                right *= yes[r] if v == 1 else 1 - yes[r]
                wrong *= no[r] if v == -1 else 1 - no[r]
        return right / (right + wrong)

    total = sum(patterns.values())
    for _ in range(rounds):
        share = {v: posterior(v) for v in patterns}
        mass = sum(n * share[v] for v, n in patterns.items())

        def accuracy(r, vote, start, weigh, whole):
            prior = quality.PRIOR_WEIGHT * whole + 1
            hit = sum(n * weigh(v) for v, n in patterns.items() if v[r] == vote)
            cast = sum(n * weigh(v) for v, n in patterns.items() if v[r])
            return (hit + start * prior) / (cast + prior)

        yes = [accuracy(r, 1, quality.START_YES, lambda v: share[v], mass) for r in range(size)]
        no = [accuracy(r, -1, quality.START_NO, lambda v: 1 - share[v], total - mass) for r in range(size)]
        good = (mass + quality.START_GOOD) / (total + 1)
    return {v: posterior(v) for v in patterns}


@pytest.mark.parametrize("source", [table, documents])
def test_quality(spark, source):
    df = source(spark)
    rows = quality.assessed(df).collect()
    assert len(rows) == df.count()
    known = texts(df)
    expected = estimate(Counter(tuple(r.votes) for r in rows))
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == measured(known[r.doc_id])
        assert r.p_good == pytest.approx(expected[tuple(r.votes)], rel=1e-6)
        assert r.kept == (not r.base_failed and r.p_good >= quality.THRESHOLD)
    good = quality.good_documents(df)
    assert good.columns == df.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_quality_tells_labels(spark):
    rows = quality.assessed(documents(spark)).join(
        spark.read.parquet(f"{BASE}/labels.parquet"), "doc_id"
    ).where("NOT base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_rules_are_as_many_as_said(spark):
    assert len(quality.rules()) == quality.N_RULES


def test_empty_tables(spark):
    none = table(spark).limit(0)
    assert quality.assessed(none).count() == 0
    assert quality.good_documents(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert mixing.mixed(none).columns == none.columns and mixing.mixed(none).count() == 0


def test_mixture_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{BASE}/documents.parquet'")
    want = sorted(con.execute(mixing.MIX_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.mixture(documents(spark)).collect()) == want


def filled(sizes, weights, epochs):
    """Water-filling round by round."""
    targets, open_ = {}, dict(weights)
    left = sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > epochs * sizes[s]]
        if not full:
            return targets | {s: w * level for s, w in open_.items()}
        for s in full:
            targets[s] = epochs * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_targets_stop_at_epochs(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 0, None: 300, "e": 5}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, 3)
    for r in mixing.source_targets(df).collect():
        assert r.target == pytest.approx(want[r.source])


def test_mixed_rows(spark):
    df = table(spark)
    taken = {}
    for r in mixing.mixture(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        assert r.taken <= 3 * r.size
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.mixed(df).collect()))
