"""The pipeline against its stages written plainly."""

import hashlib
from collections import Counter

import corpus_pipeline
from gradus.llm import lines, mixing, quality
from tests.llm.helpers import BASE, WORD, documents, table
from tests.llm.test_duplicates import component_of, line_rows, shingle_sets


def plain(rows, kept_ids, taken):
    rows = [r for r in rows if r["doc_id"] in kept_ids]
    sets = [
        (r["doc_id"], n, frozenset(lines.line_words(line)))
        for r in sorted(rows, key=lambda r: r["doc_id"])
        for n, line in enumerate(r["text"].split("\n"))
    ]
    gone = line_rows([s for s in sets if len(s[2]) >= lines.MIN_WORDS])
    for r in rows:
        left = [x for n, x in enumerate(r["text"].split("\n")) if (r["doc_id"], n) not in gone]
        r["text"] = "\n".join(left)
    component = component_of(shingle_sets([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    return rows


def test_pipeline(spark):
    docs = documents(spark)
    good = {r.doc_id for r in quality.assessed(docs).collect() if r.kept}
    assert {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, BASE).collect()} == good
    rows = [r.asDict() for r in docs.collect()]
    want = plain(rows, good, None)
    stage = docs
    for _, function in corpus_pipeline.STAGES[:3]:
        stage = function(spark, stage, BASE)
        assert stage.columns == docs.columns
    got = {r.doc_id: r for r in stage.collect()}
    assert {r["doc_id"]: r["text"] for r in want} == {k: r.text for k, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    left = spark.createDataFrame(want, docs.schema)
    taken = {r.doc_id: r for r in mixing.mixture(left).collect()}
    copies = Counter(r.doc_id for r in corpus_pipeline.run(spark, BASE).collect())
    for key, r in taken.items():
        assert r.size == len(WORD.findall(got[key].text))
        assert r.size == 0 or copies[key] == r.taken // r.size
    digests = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, BASE).collect()}
    assert all(digests[k] == hashlib.sha256(got[k].text.encode()).hexdigest() for k in digests)


def test_awkward_rows(spark):
    docs = table(spark)
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, BASE)
        assert docs.columns == table(spark).columns
    assert corpus_pipeline.tokenize(spark, docs, BASE).count() == docs.count()


def test_empty_table(spark):
    docs = table(spark).limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, BASE)
    assert docs.count() == 0
