"""Byte-pair coding and counting against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gradus.llm import bpe, token_counts
from gradus.llm.words import piece_finder
from tests.llm.helpers import documents, table, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )


def hard_texts():
    draw = random.Random(3)
    made = ["".join(draw.choice("abcdehiorst") for _ in range(draw.randrange(65, 600))) for _ in range(12)]
    return [
        "a" * 5000, "ab" * 2000, "thethethe" * 100, " \x1c\x85  x", "日本語テキスト" * 40, "🎉" * 90,
        "he'll don't''s", "²³½ ¼a1", "\xa0\xa0 a\n\n b\t\t", "the " * 50 + " " * 90, "ﬁŽ'ɐabc 12'S",
        "<|endoftext|>a<|endoftext|> b", *made,
    ]


def test_pieces_equal_the_pattern():
    import regex

    pattern, pieces = regex.compile(public_tokenizers.PATTERN), piece_finder()
    draw = random.Random(5)
    letters = "aZé ßñ\t\n\xa0\x85\x1c'sdtlv12²½ªº.,-_|日ɏɐ"
    for _ in range(2000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        assert pieces(text) == pattern.findall(text), text


def test_ids_and_bytes(spark, library):
    rows = list(enumerate(hard_texts())) + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = bpe.encode(df, RANKS)
    ids = {r.doc_id: r.ids for r in coded.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, RANKS).collect()}
    for key, text in rows:
        assert ids[key] == library.encode_ordinary(text or "")
        assert back[key] == (text or "").encode()


def test_digests(spark, library):
    for df in (table(spark), documents(spark)):
        rows = bpe.digests(df, RANKS).collect()
        assert len(rows) == df.count()
        known = texts(df)
        for r in rows:
            ids = library.encode_ordinary(known[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].encode()).hexdigest()


def test_counts(spark):
    library = Tokenizer.from_file(VOCABULARY)
    hard = spark.createDataFrame(list(enumerate(hard_texts())), "doc_id long, text string")
    for df in (table(spark), documents(spark), hard):
        rows = token_counts.count_tokens(df, VOCABULARY).collect()
        assert len(rows) == df.count()
        known = texts(df)
        for r in rows:
            want = len(library.encode(known[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens) == (len(known[r.doc_id].encode()), want)
            assert r.over_limit == (want > 1024)


def test_empty(spark):
    none = table(spark).limit(0)
    assert bpe.digests(none, RANKS).count() == 0
    assert token_counts.count_tokens(none, VOCABULARY).count() == 0


def test_counts_under_awkward_names(spark):
    df = spark.createDataFrame([(1.5, "one two", 3), (None, None, 4)], "`a.id` double, `the.text` string, text int")
    out = token_counts.count_tokens(df, VOCABULARY, "a.id", "the.text")
    assert out.columns == ["a.id", "n_bytes", "n_tokens", "over_limit"]
    assert {r[0]: (r.n_bytes, r.n_tokens > 0) for r in out.collect()} == {1.5: (7, True), None: (0, False)}
