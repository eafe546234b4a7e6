"""Words, tokenizer pieces and per-worker memory shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the operators' contracts: no blank and no ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Below this code point a text's pieces are found with explicit character classes.
_LATIN_END = 0x250


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def piece_finder() -> Callable[[str], list[str]]:
    """Splits a text as public_tokenizers.PATTERN does.

    Texts of Latin letters alone, most of them, go through the standard library's faster engine
    with the classes of PATTERN written out; any other text through ``regex``. Both give the same.
    """
    import re

    import public_tokenizers
    import regex

    def among(kind: str) -> str:
        found = (c for c in map(chr, range(_LATIN_END)) if unicodedata.category(c)[0] == kind)
        return "".join(map(re.escape, found))

    letters, numbers, blanks = among("L"), among("N"), r"\t-\r \x85\xa0"
    latin = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+"
        rf"| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    )
    beyond = re.compile(f"[^\\x00-{chr(_LATIN_END - 1)}]").search
    any_text = regex.compile(public_tokenizers.PATTERN)
    return lambda text: (any_text if beyond(text) else latin).findall(text)


def worker_memory(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in each Python worker and kept for its later tasks.

    Task functions travel by value, so a module's own globals would be new in each task.
    """
    import sys

    kept = sys.__dict__.setdefault("_gradus_worker_memory", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(batch, rows: int = 512):
    """Parts of an Arrow batch, so that only a few texts are Python objects at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
