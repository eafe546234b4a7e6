"""Token counts by byte-pair merging with a heap and a linked list, without making the tokens.

A text is cut into the vocabulary's special strings and, between them, the pieces of the
tokenizer's pattern. A piece starts as its bytes. The heap gives the adjacent pair of lowest rank,
leftmost first, again and again; the pair becomes one symbol in the linked list and its neighbours
offer new pairs. The count is the number of bytes less the number of merges.

Nulls are empty texts of 0 bytes and 0 tokens. A row gives one row, repeated rows too; only the id
and the text column are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.llm.words import piece_finder, slices, worker_memory

#: Pieces whose count a worker remembers; beyond it starts anew.
MEMORY = 1_000_000


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write byte b as its own character if that is visible, and the
    others, in order, as the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_merges(path: str) -> dict:
    """Pair of symbols -> rank, rank -> symbol, special strings, of a byte-level BPE file.

    Symbols are numbered as they are first made, bytes first. Other kinds of file are refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = spec["normalizer"] is None and not model.get("byte_fallback")
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not plain:
        raise ValueError(f"{path} is no byte-level BPE vocabulary")
    if pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} cuts its texts in another way")
    byte, symbols = _byte_of(), {bytes([b]): b for b in range(256)}
    pairs, made = {}, []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        a, b = (bytes(byte[c] for c in part) for part in (left, right))
        pairs[symbols[a] << 20 | symbols[b]] = rank
        made.append(symbols.setdefault(a + b, len(symbols)))
    special = [t["content"] for t in spec["added_tokens"] if t["content"]]
    return {"pairs": pairs, "made": made, "special": special}


def merge_counter(pairs: dict[int, int], made: list[int]) -> Callable[[bytes], int]:
    from heapq import heapify, heappop, heappush

    rank_of = pairs.get

    def count(piece: bytes) -> int:
        symbols, size = list(piece), len(piece)
        heap = []
        for at in range(size - 1):
            rank = rank_of(symbols[at] << 20 | symbols[at + 1])
            if rank is not None:
                heap.append(rank * size + at)
        if not heap:
            return size
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        left = size
        while heap:
            rank, at = divmod(heappop(heap), size)
            right = after[at]
            if right >= size or symbols[at] < 0:
                continue
            if rank_of(symbols[at] << 20 | symbols[right]) != rank:
                continue
            new = symbols[at] = made[rank]
            symbols[right] = -1
            left -= 1
            right = after[at] = after[right]
            if right < size:
                before[right] = at
                rank = rank_of(new << 20 | symbols[right])
                if rank is not None:
                    heappush(heap, rank * size + at)
            previous = before[at]
            if previous >= 0:
                rank = rank_of(symbols[previous] << 20 | new)
                if rank is not None:
                    heappush(heap, rank * size + previous)
        return left

    return count


def text_counter(vocabulary: dict, memory: int = MEMORY) -> Callable[[str], int]:
    """Counts a text's tokens; the counts of pieces seen before are remembered."""
    import re

    count, pieces = merge_counter(vocabulary["pairs"], vocabulary["made"]), piece_finder()

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            if len(self) >= memory:
                self.clear()
            found = self[piece] = count(piece.encode())
            return found

    counted = Counts().__getitem__
    special = sorted(vocabulary["special"], key=len, reverse=True)
    cut = re.compile("|".join(map(re.escape, special))) if special else None

    def text_tokens(text: str) -> int:
        if cut is None or not cut.search(text):
            return sum(map(counted, pieces(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(counted, pieces(part))) for part in parts)

    return text_tokens


def count_tokens(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, tokens by the file at ``path``.

    The file is read by the driver and broadcast: its size is that of the vocabulary, whatever the
    table. Rows are not shuffled.
    """
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(load_merges(path))

    def tasks(batches):
        counter = worker_memory(f"counts {digest}", lambda: text_counter(shared.value))
        for batch in batches:
            for part in slices(batch):
                counts = [counter(t) if t else 0 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64())],
                    names=["id", "n_bytes", "n_tokens"],
                )

    text = F.col(f"`{text_column}`")
    narrow = df.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        text.alias("text"),
    )
    id_type = narrow.schema["id"].dataType.simpleString()
    counted = narrow.mapInArrow(tasks, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", over)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(read(spark, base, "documents"), path, limit=1024)
