"""Text expressions shared by the jobs. All are native columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def normalised(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed, null as empty."""
    return collapse(F.lower(strip(F.coalesce(text, F.lit("")))))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base, derived from Unicode decomposition."""
    plain, accented = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code).lower()
        parts = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(parts) > 1 and len(parts[0]) == 1:
            if letter not in accented:
                accented.append(letter)
                plain.append(parts[0])
    return "".join(accented) + "đ", "".join(plain) + "d"


_ACCENTED, _PLAIN = _folding()


def folded(text: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\p{Mn}", ""), r"(?U)\s+", " "))


def meaningful_tokens(folded_text: Column, stop_words: list[str]) -> Column:
    found = F.regexp_extract_all(folded_text, F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words]))


def contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def mentions(text: Column, markers: list[str]) -> Column:
    """Whether a marker occurs: phrases and words over four letters anywhere, others as a word."""
    loose = [m for m in markers if " " in m or len(m) > 4]
    strict = [m for m in markers if m not in loose]
    hit = contains_any(text, loose)
    if strict:
        hit = hit | text.rlike(r"(?U)(?<!\w)(?:" + "|".join(strict) + r")(?!\w)")
    return F.coalesce(hit, F.lit(False))


_ASCII_WORD = "[A-Za-z0-9_]"
#: Where a word of ASCII letters, digits and _ starts or ends.
ASCII_EDGE = f"(?:(?<={_ASCII_WORD})(?!{_ASCII_WORD})|(?<!{_ASCII_WORD})(?={_ASCII_WORD}))"


def words_of(pattern: str, ascii_words: bool = False) -> str:
    """The pattern with edges of words and white space of Unicode, or of ASCII as DuckDB has them."""
    if not ascii_words:
        return "(?U)" + pattern
    return pattern.replace(r"\b", ASCII_EDGE).replace(r"\-\s", r"\-\t\n\f\r ").replace(r"\s", r"[\t\n\f\r ]")


def stable_id(*parts: Column) -> Column:
    """Identifier that a rerun gives again."""
    return F.md5(F.concat_ws("#", *[p.cast("string") for p in parts]))


UUID = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))
