"""Small tables with the awkward cases that every operator must take."""

import os
import re

BASE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = (
    "The committee met on Tuesday to discuss the new bridge over the river and the cost of it. "
    "Members asked how long the work would take, and whether the old road could stay open for now."
)
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))

AWKWARD = [
    (1, PROSE),
    (2, PROSE),
    (2, PROSE),
    (3, PROSE.replace("Tuesday", "Friday")),
    (4, ""),
    (5, None),
    (6, " \t\n "),
    (7, "one two"),
    (8, "One  TWO"),
    (9, LONG),
    (10, "x" * 20_000),
    (11, "Ünïcödé 日本語 🎉 <|endoftext|> text"),
    (None, "a row without an id but with enough words to be looked at by every rule here"),
    (12, "\n".join([PROSE, "short", "short", "A line that stands twice in this one text.", PROSE])),
]


def table(spark, rows=AWKWARD):
    """Documents, with the columns of the real table and some whose names operators use inside."""
    full = [(k, t, "en" if k != 7 else None, None if k == 6 else "s", len(t or "")) for k, t in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.selectExpr(
        "*", "1 AS n", "'k' AS key", "2 AS line", "'x' AS digest", "0 AS row", "'t' AS token",
        "3 AS size", "true AS kept", "'h' AS host", "5 AS _picked", "6 AS votes",
    )


def documents(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
