from collections import Counter

import pytest

from gradus.llm import fingerprints, lines, links, minmax
from tests.llm.helpers import PROSE, WORD, documents, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(spark, count=60):
    """A hub with many variants, a shared passage in unrelated texts, and exact copies."""
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = []
    for i in range(count):
        own = [f"w{i}x{k}" for k in range(120)]
        rows.append((i, " ".join(own[:60]) + " " + passage + " " + " ".join(own[60:])))
        hub = [f"hub{k}" for k in range(200)]
        hub[(7 * i) % 200] = f"changed{i}"
        rows.append((1000 + i, " ".join(hub)))
        rows.append((2000 + i, PROSE))
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingle_sets(rows):
    sets = {}
    for key, text in rows:
        words = WORD.findall((text or "").translate(LOW))
        if words:
            sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        else:
            sets[key] = set()
    return sets


def component_of(sets):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("source", [table, documents, near_copies])
def test_components(spark, source):
    df = source(spark)
    rows = minmax.near_duplicates(df).collect()
    assert len(rows) == df.count()
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    sets = shingle_sets([g for g in given if g[0] is not None])
    want = component_of(sets)
    for r in rows:
        if r.doc_id is None:
            assert r.kept
            continue
        assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id]))
        assert r.kept == (r.doc_id == want[r.doc_id])
    left = minmax.representatives(df)
    assert left.columns == df.columns
    kept = Counter(r.doc_id for r in rows if r.kept)
    assert Counter(r.doc_id for r in left.collect()) == kept


def test_components_of_a_path(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in links.components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert links.components(df.limit(0)).count() == 0


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (100, 300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tracker, taken = spark.sparkContext.statusTracker(), {}
        for limit in (links.ROUND_LINKS, 0):
            monkeypatch.setattr(links, "ROUND_LINKS", limit)
            spark.sparkContext.setJobGroup(f"components {limit}", "")
            assert {r.node: r.component for r in links.components(df).collect()} == want
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components {limit}")]
            stages = {k for job in jobs for k in job.stageIds}
            taken[limit] = sum(tracker.getStageInfo(k).numTasks for k in stages if tracker.getStageInfo(k))
        # Before, each round dealt its few links over all partitions of several shuffles.
        assert taken[100_000] < 400 < taken[0]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def line_rows(rows):
    first, earlier, removed = {}, [], {}
    for key, number, words in rows:
        if words in first:
            removed[key, number] = False
            continue
        if any(100 * len(words & o) >= 85 * len(words | o) for o in earlier):
            removed[key, number] = True
        first[words] = (key, number)
        earlier.append(words)
    return removed


def variants(spark):
    rows = []
    for i in range(40):
        line = [f"w{k}" for k in range(30)]
        line[i % 30] = f"changed{i}"
        rows.append((i, " ".join(line) + f"\nown line number {i} of text {i}\nthe of and\n" + PROSE))
    return spark.createDataFrame(rows, "doc_id long, text string")


def drifting(spark):
    """Each line is similar to the ones just before it and to none far away: not to its word's leaders."""
    rows = []
    for series in range(3):
        words = [f"s{series}w{k}" for k in range(40)]
        for step in range(60):
            words[(7 * step) % 40] = f"s{series}x{step}"
            rows.append((series * 100 + step, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("source", [table, documents, variants, drifting])
def test_lines(spark, source):
    df = source(spark)
    given = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
    sets = [
        (key, number, frozenset(lines.line_words(line)))
        for key, text in sorted(given.items())
        for number, line in enumerate(text.split("\n"))
    ]
    want = line_rows([s for s in sets if len(s[2]) >= lines.MIN_WORDS])
    _, removed = lines.removals(df)
    rows = removed.collect()
    assert {(r.doc_id, r.line): r.near for r in rows} == want
    at = {(k, n): w for k, n, w in sets}
    for r in rows:
        x, y = at[r.doc_id, r.line], at[r.to_doc, r.to_line]
        assert (r.to_doc, r.to_line) < (r.doc_id, r.line)
        assert 100 * len(x & y) >= 85 * len(x | y)
    out = lines.deduplicated(df)
    assert out.columns == df.columns and out.count() == df.count()
    for r in out.select("doc_id", "text").collect():
        if r.doc_id in given and given[r.doc_id]:
            left = [x for n, x in enumerate(given[r.doc_id].split("\n")) if (r.doc_id, n) not in want]
            assert r.text == "\n".join(left)


@pytest.mark.parametrize("source", [table, documents])
def test_fingerprints(spark, source):
    import hashlib

    df = source(spark)
    rows = fingerprints.edited(df).collect()
    assert len(rows) == df.count()
    given = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    known = [g for g in given if g[0] is not None]
    known.sort(key=lambda g: -g[0])
    order = known + [g for g in given if g[0] is None]
    after = {key: order[(i + 1) % len(order)][1] for i, (key, _) in enumerate(order)}
    text_of = dict(given)
    prints = {}
    for r in rows:
        text, following = text_of[r.doc_id], after[r.doc_id]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        if r.doc_id != 2:  # given twice, the first of which is followed by the second
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert (r.near_next == 1) == (text == following)
        assert 0 <= r.near_edited <= 1 and r.near_edited >= 0.49
        assert prints.setdefault(r.fingerprint, text) == text
    assert len(prints) == len(set(text_of.values()))


@pytest.mark.parametrize("kind", ["decimal(20,0)", "date"])
def test_fingerprints_by_ids_of_other_types(spark, kind):
    """Rows meet across the borders of partitions whatever the type of the id."""
    df = spark.range(40).selectExpr("id", "concat('text ', id, ' of forty') AS text").repartition(7)
    key = "date_from_unix_date(int(id))" if kind == "date" else f"CAST(id AS {kind})"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = fingerprints.edited(df.selectExpr(f"{key} AS doc_id", "text")).collect()
        want = fingerprints.edited(df.selectExpr("id AS doc_id", "text")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 40
    assert {tuple(r)[1:] for r in rows} == {tuple(r)[1:] for r in want}


def test_spans_and_extensions():
    text = fingerprints.Prefixes.of("abcabcabcd" * 30)
    other = fingerprints.Prefixes.of("xx" + "abcabcabcd" * 20 + "z")
    assert fingerprints.same_span(text, 0, text, 3, 6)
    assert not fingerprints.same_span(text, 0, text, 3, 7)
    assert fingerprints.common_extension(text, 0, other, 2) == 200
    assert fingerprints.likeness(text, text) == 1
    words = PROSE.split()
    changed = words[:5] + ["other"] + words[6:20] + words[22:]
    near = fingerprints.likeness(*map(fingerprints.Prefixes.of, (PROSE, " ".join(changed))))
    assert 0.7 < near < 1


def test_empty_tables(spark):
    none = table(spark).limit(0)
    assert minmax.near_duplicates(none).count() == 0
    assert lines.deduplicated(none).count() == 0
    assert fingerprints.edited(none).count() == 0


def test_lines_that_pass_the_bounds_with_the_first_but_are_not_similar(spark):
    """The parity maps of two lines agree by chance: the line is compared with the others after all."""
    import numpy as np

    one = [np.ones(1, np.uint64)], [np.ones(1, np.uint64)]

    def bits(words):
        block = lines.Block([0], [" ".join(words)], ([*one[0]], [*one[1]]))
        return int.from_bytes(block.parities().tobytes(), "little")

    base = [f"b{i}" for i in range(20)]
    changed = next(
        words
        for i in range(5000)
        for words in [base[:18] + [f"p{i}", f"q{i}"]]
        if (bits(base) ^ bits(words)).bit_count() <= 2
    )
    rows = [(1, " ".join(base)), (2, " ".join([*changed, "extra"])), (3, " ".join(changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.to_doc) for r in lines.removals(df)[1].collect()}
    assert got == {(3, 2)}


def test_short_lines_that_repeat(spark):
    """Lines of one and two distinct words go like all others; only lines without words stay."""
    script = "日本語の段落は一つの語である。" * 20
    texts = [
        "Read more\n\nla la la la\na b c d e\n" + script,
        "read  MORE\n\nLA la\n" + script + "\nmore",
        "more\n \na b c d e f\nRead\nmore read\nf e d c b a g",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [
        (key, number, frozenset(lines.line_words(line)))
        for key, text in enumerate(texts)
        for number, line in enumerate(text.split("\n"))
    ]
    want = line_rows([s for s in sets if s[2]])
    assert want == {(1, 0): False, (1, 2): False, (1, 3): False, (2, 0): False, (2, 4): False, (2, 5): True}
    assert {(r.doc_id, r.line): r.near for r in lines.removals(df)[1].collect()} == want
    left = {r.doc_id: r.text for r in lines.deduplicated(df).collect()}
    assert left == {0: texts[0], 1: "\nmore", 2: " \na b c d e f\nRead"}
    _, removed = lines.removals(df, min_words=3)
    assert {(r.doc_id, r.line): r.near for r in removed.collect()} == {(2, 5): True}


def drifting(spark):
    """Each line is similar to the ones just before it and to none far away: not to its word's leaders."""
    rows = []
    for series in range(3):
        words = [f"s{series}w{k}" for k in range(40)]
        for step in range(60):
            words[(7 * step) % 40] = f"s{series}x{step}"
            rows.append((series * 100 + step, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("source", [table, documents, variants, drifting])
def test_lines_against_all_pairs(spark, source):
    """All lines with a word, whatever the constants of the module are."""
    df = source(spark)
    given = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
    sets = [
        (key, number, frozenset(lines.line_words(line)))
        for key, text in sorted(given.items())
        for number, line in enumerate(text.split("\n"))
    ]
    want = line_rows([s for s in sets if s[2]])
    assert {(r.doc_id, r.line): r.near for r in lines.removals(df)[1].collect()} == want


@pytest.mark.parametrize("shares", [(0.05, 0.95), (1 / 3, 2 / 3)])
@pytest.mark.parametrize("size", [100, 3000])
def test_likeness_over_long_differences(shares, size):
    """What stands between two long insertions, or two long replaced stretches, still counts."""
    import random

    draw = random.Random(5)

    def made(count):
        return "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=count))

    text = made(20_000)
    first, second = (int(20_000 * share) for share in shares)
    inserted = text[:first] + made(size) + text[first:second] + made(size) + text[second:]
    replaced = text[: first - size] + made(size) + text[first:second] + made(size) + text[second + size :]
    replaced = replaced if first >= size and second + size <= 20_000 else None
    for other in filter(None, (inserted, replaced)):
        want = (20_000 if other is inserted else 20_000 - 2 * size) / len(other)
        for pair in ((text, other), (other, text)):
            assert fingerprints.likeness(*map(fingerprints.Prefixes.of, pair)) == pytest.approx(want, abs=0.005)


def test_likeness_of_unrelated_texts():
    pair = [fingerprints.Prefixes.of(chr(97 + k) * 5000) for k in range(2)]
    assert fingerprints.likeness(*pair) == 0
    assert fingerprints.likeness(fingerprints.Prefixes.of("short"), pair[0]) == 0


def test_line_pieces_and_rounds(spark, monkeypatch):
    """Texts in pieces, one earlier line in a round, and arrays of earlier lines from the first on."""
    for name, value in (("BLOCK_BYTES", 50), ("FIRST_ROUND", 1), ("BROADCAST_LINES", 0), ("PICK_LIMIT", 0)):
        monkeypatch.setattr(lines, name, value)
    monkeypatch.setattr(lines._Earlier, "FEW", 2)
    for source in (drifting, variants, table):
        test_lines(spark, source)


@pytest.mark.parametrize("source, side", [(table, 512), (variants, 5), (drifting, 9)])
def test_all_pairs_of_similar_lines(spark, monkeypatch, source, side):
    """Every link between lines of different sets, not one for each line; blocks of any size give the same."""
    monkeypatch.setattr(lines, "SIDE", side)
    df = source(spark)
    given = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
    first = {}
    for key, text in sorted(given.items()):
        for number, line in enumerate(text.split("\n")):
            words = frozenset(lines.line_words(line))
            if words:
                first.setdefault(words, (key, number))
    want = {
        (*max(p, q), *min(p, q))
        for x, p in first.items()
        for y, q in first.items()
        if p != q and 100 * len(x & y) >= 85 * len(x | y)
    }
    documents, removed, near = lines.linked(df)
    rows = [(r.doc_id, r.line, *y) for r in near.collect() for y in r.similar]
    assert len(rows) == len(want) and set(rows) == want
    gone = {(r.doc_id, r.line): (r.to_doc, r.to_line, r.near) for r in removed.collect()}
    assert {k: t[2] for k, t in gone.items()} == {
        (r.doc_id, r.line): r.near for r in lines.removals(df)[1].collect()
    }
    for x_doc, x_line, *y in want:
        assert gone[x_doc, x_line][:2] <= tuple(y)
