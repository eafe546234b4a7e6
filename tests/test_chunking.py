import random

from conftest import rows

from gradus.operators import chunking


def plain_split(text, separators, size, overlap):
    """The same rules on lists of strings."""
    separator = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(separator) + 1 :]
    if separator:
        head, *tail = text.split(separator)
        parts = [p for p in [head, *[separator + t for t in tail]] if p]
    else:
        parts = list(text)
    out, run = [], []

    def flush():
        current = []
        for part in run:
            if sum(map(len, current)) + len(part) > size and current:
                out.append("".join(current))
                while current and (
                    sum(map(len, current)) > overlap
                    or sum(map(len, current)) + len(part) > size
                ):
                    current.pop(0)
            current.append(part)
        if current:
            out.append("".join(current))
        run.clear()

    for part in parts:
        if len(part) < size:
            run.append(part)
            continue
        flush()
        if rest:
            out.extend(plain_split(part, rest, size, overlap))
        else:
            out.append(part)
    flush()
    return out


def test_split_follows_the_rules():
    rng = random.Random(4)
    for _ in range(300):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 9, 40]))) for _ in range(30)]
        text = "".join(p + rng.choice([" ", " ", "\n", "\n\n", "  ", ""]) for p in pieces).strip()
        if not text:
            continue
        want = [c.strip() for c in plain_split(text, list(chunking.SEPARATORS), 20, 5)]
        assert chunking.split_text(text, 20, 5) == [c for c in want if c]


def test_chunks_cover_texts_within_size(spark):
    sentences = [f"Câu văn số {i}." + ("\n\n" if i % 50 == 49 else " ") for i in range(300)]
    text = "".join(sentences) + "".join(f"{i:05d}" for i in range(500))
    df = spark.createDataFrame([(1, text), (2, None), (3, "ngắn")], "doc bigint, text string")
    got = chunking.recursive_chunks(df, "doc").orderBy("doc", "chunk_index").collect()
    mine = [r for r in got if r["doc"] == 1]
    assert [r["chunk_index"] for r in mine] == list(range(len(mine)))
    assert all(0 < r["char_count"] == len(r["content"]) <= 1000 for r in mine)
    place = 0
    for r in mine:
        at = text.find(r["content"])
        assert at != -1
        place = max(place, at + len(r["content"]))
    assert "".join(text[place:].split()) == ""
    assert [r["content"] for r in got if r["doc"] == 3] == ["ngắn"]


def test_paragraphs(spark):
    df = spark.createDataFrame([(7, "a\n\n\r\n\r\n b \r\n\r\nc")], "doc bigint, text string")
    assert rows(chunking.paragraph_chunks(df, "doc"), "chunk_id", "content") == [
        ("7_chunk_1", "a"), ("7_chunk_2", "b"), ("7_chunk_3", "c"),
    ]


def test_texts_of_a_batch_are_cut_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunking, "TEXTS_AT_ONCE", 7)
    texts = [None if k % 9 == 0 else "word " * (k * 5) + "\n\n" + "x" * k for k in range(60)]
    df = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "id string, text string")
    got = sorted(tuple(r) for r in chunking.recursive_chunks(df, "id", size=40, overlap=8).collect())
    want = sorted(
        (f"k{k}", i, c, len(c))
        for k, t in enumerate(texts)
        for i, c in enumerate(chunking.split_text((t or "").strip(), 40, 8))
    )
    assert got == want
