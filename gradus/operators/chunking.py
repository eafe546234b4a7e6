"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import strip

# Chunk size, overlap and the order in which separators are tried.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ", "")
#: Texts of an Arrow batch that are Python strings, with their chunks, at once.
TEXTS_AT_ONCE = 128


def _pieces(text: str, start: int, end: int, separator: str) -> list[int]:
    """Cut positions of a stretch, each piece but the first beginning with the separator."""
    if not separator:
        return list(range(start, end + 1))
    cuts, at = [start], text.find(separator, start, end)
    while at != -1:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    return [*cuts, end]


def _spans(
    text: str, start: int, end: int, level: int, size: int, overlap: int
) -> Iterator[tuple[int, int]]:
    while SEPARATORS[level] and text.find(SEPARATORS[level], start, end) == -1:
        level += 1
    cuts = _pieces(text, start, end, SEPARATORS[level])
    run = 0
    for i in range(len(cuts) - 1):
        if cuts[i + 1] - cuts[i] >= size and level + 1 < len(SEPARATORS):
            yield from _packed(cuts[run : i + 1], size, overlap)
            yield from _spans(text, cuts[i], cuts[i + 1], level + 1, size, overlap)
            run = i + 1
    yield from _packed(cuts[run:], size, overlap)


def _packed(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring pieces in stretches of at most ``size``, starting over within ``overlap``."""
    first = 0
    for i in range(1, len(cuts)):
        if cuts[i] - cuts[first] > size and i - 1 > first:
            yield cuts[first], cuts[i - 1]
            while first < i - 1 and (
                cuts[i - 1] - cuts[first] > overlap or cuts[i] - cuts[first] > size
            ):
                first += 1
    if len(cuts) > 1:
        yield cuts[first], cuts[-1]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    if not text:
        return []
    found = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap))
    return [chunk for chunk in found if chunk]


def recursive_chunks(
    documents: DataFrame,
    key: str,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Rows (key, chunk_index, content, char_count). Needs no shuffle."""
    key_type = documents.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, chunk_index int, content string, char_count int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                owner, index, chunks = [], [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    found = split_text(t.strip() if t else "", size, overlap)
                    owner += [k] * len(found)
                    index += range(len(found))
                    chunks += found
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int32())),
                        pa.array(index, pa.int32()),
                        pa.array(chunks, pa.string()),
                        pa.array([len(c) for c in chunks], pa.int32()),
                    ],
                    names=[key, "chunk_index", "content", "char_count"],
                )

    return documents.select(key, text).mapInArrow(cut, schema)


def paragraph_chunks(
    documents: DataFrame, key: str, text: str = "text", separator: str = r"\r?\n\r?\n"
) -> DataFrame:
    """Rows (key, chunk_id, chunk_index from 1, content), one per non-empty paragraph."""
    parts = F.filter(F.split(text, separator), lambda p: p != "")
    return documents.select(key, F.posexplode(parts).alias("_pos", "_part")).select(
        key,
        F.concat_ws("_chunk_", F.col(key).cast("string"), (F.col("_pos") + 1).cast("string")).alias(
            "chunk_id"
        ),
        (F.col("_pos") + 1).alias("chunk_index"),
        strip(F.col("_part")).alias("content"),
    )
