"""Which phrases stand anywhere in which texts, by an inverted index of short stretches.

A text that contains a phrase contains all of its stretches of ``GRAM`` characters, so it is enough to
look a phrase up by its rarest one and to compare only the texts found there. Shorter phrases are looked
up as they are. The index is a table (gram, text) restricted to the grams that some phrase has; phrases
and texts meet in equi-joins, and a text is compared once with all its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Grams of phrases that may be broadcast to the texts, some 50 bytes each; beyond it they are joined.
BROADCAST_GRAMS = 500_000


def _stretches(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


def grams(text: Column, sizes: list[int]) -> Column:
    """Distinct stretches of a text, of all the sizes."""
    return F.array_distinct(F.concat(*[_stretches(text, n) for n in sizes]))


def small(rows: DataFrame, limit: int) -> DataFrame:
    """Rows to join with, broadcast if they were counted and are few."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def index(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, chosen): (gram, key) of the texts, and (phrase, gram, texts) with each phrase's rarest
    gram and how many texts hold that. Phrases with a gram that no text has are left out, they are
    nowhere. ``phrases``: phrase, distinct and not empty."""
    short = F.array(F.col("phrase"))
    own = phrases.select(
        "phrase",
        F.explode(
            F.when(F.length("phrase") < GRAM, short).otherwise(F.array_distinct(_stretches(F.col("phrase"), GRAM)))
        ).alias("gram"),
    )
    wanted = small(own.select("gram").distinct(), BROADCAST_GRAMS)
    all_sizes = list(range(1, GRAM + 1))
    places = texts.select(key, F.explode(grams(F.col(text), all_sizes)).alias("gram")).join(wanted, "gram")
    counted = places.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("r")
    chosen = own.join(counted, "gram", "left").groupBy("phrase").agg(rarest)
    return places, chosen.where("r.texts > 0").select("phrase", "r.gram", "r.texts")


def hits(texts: DataFrame, key: str, text: str, places: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, phrase) of every text and each of the ``chosen`` phrases that it contains."""
    looked_up = small(chosen.select("gram", "phrase"), BROADCAST_GRAMS)
    found = places.join(looked_up, "gram").groupBy(key).agg(F.collect_list("phrase").alias("_phrases"))
    return found.join(texts.select(key, F.col(text).alias("_text")), key).select(
        key, F.explode(F.filter("_phrases", lambda p: F.contains(F.col("_text"), p))).alias("phrase")
    )


def containing(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """(text, phrase) of the distinct texts of a column and the phrases that each contains."""
    places, chosen = index(texts, text, text, phrases)
    return hits(texts, text, text, places, chosen)
