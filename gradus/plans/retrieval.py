"""Queries for chunking and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import chunking
from gradus.operators import retrieval as ops
from gradus.plans import query, views
from gradus.plans.catalog import _snapshot_and_chunks
from gradus.sources.tables import table


def _chunk_level(n: int, separator: str) -> str:
    """Pieces of the stretches of one level; the small ones side by side as runs of cuts, the others
    as the stretches of the next level."""
    return f"""
p{n} AS (
  SELECT doc_id, a, i, piece, a + sum(length(piece)) OVER w AS stop, length(piece) >= {chunking.CHUNK_SIZE} AS big
  FROM (SELECT doc_id, a, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (
    SELECT doc_id, a, list_filter(list_transform(string_split(t, {separator}),
      lambda x, k: CASE WHEN k = 1 THEN x ELSE {separator} || x END), lambda x: x <> '') AS pieces FROM s{n}))
  WINDOW w AS (PARTITION BY doc_id, a ORDER BY i)),
r{n} AS (
  SELECT doc_id, list_concat([min(stop - length(piece))::BIGINT], list(stop::BIGINT ORDER BY i)) AS cuts
  FROM (SELECT *, sum(big::INT) OVER (PARTITION BY doc_id, a ORDER BY i) AS island FROM p{n})
  WHERE NOT big GROUP BY doc_id, a, island),
s{n + 1} AS (SELECT doc_id, (stop - length(piece))::BIGINT AS a, piece AS t FROM p{n} WHERE big)"""


_CHUNKED = f"""whole AS (
  SELECT doc_id, {views.STRIP.format('text')} AS body FROM documents),
s0 AS (SELECT doc_id, 0::BIGINT AS a, body AS t FROM whole WHERE body <> ''),
{_chunk_level(0, "repeat(chr(10), 2)")}, {_chunk_level(1, "chr(10)")}, {_chunk_level(2, "' '")},
runs AS (
  FROM r0 UNION ALL FROM r1 UNION ALL FROM r2
  UNION ALL SELECT doc_id, range(a, a + length(t) + 1) AS cuts FROM s3),
packed AS (
  SELECT doc_id, cuts, 1::BIGINT AS f,
         list_filter(range(2, len(cuts) + 1), lambda x: cuts[x] - cuts[1] > {chunking.CHUNK_SIZE})[1] AS o
  FROM runs
  UNION ALL
  SELECT doc_id, cuts, f,
         list_filter(range(o + 1, len(cuts) + 1), lambda x: cuts[x] - cuts[f] > {chunking.CHUNK_SIZE})[1] AS o
  FROM (SELECT doc_id, cuts, o, list_filter(range(f + 1, o), lambda x: x = o - 1
          OR (cuts[o - 1] - cuts[x] <= {chunking.CHUNK_OVERLAP} AND cuts[o] - cuts[x] <= {chunking.CHUNK_SIZE}))[1] AS f
        FROM packed WHERE o IS NOT NULL)),
spans AS (
  SELECT doc_id, cuts[f] AS a, CASE WHEN o IS NULL THEN cuts[len(cuts)] ELSE cuts[o - 1] END AS b FROM packed),
chunked AS (
  SELECT doc_id, a, {views.STRIP.format('substring(body, a + 1, b - a)')} AS content
  FROM spans JOIN whole USING (doc_id))"""


@query(
    "recursive_chunks",
    f"""WITH RECURSIVE {_CHUNKED}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, content,
       CAST(length(content) AS INTEGER) AS char_count
FROM chunked WHERE content <> ''""",
)
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents"), "doc_id")


@query(
    "recursive_chunk_properties",
    r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS bare FROM documents)
SELECT doc_id, length(bare) AS text_chars, true AS in_size, true AS in_text, true AS in_order,
       true AS all_covered, true AS in_overlap
FROM d WHERE bare <> ''""",
)
def recursive_chunk_properties(spark: SparkSession, d: str) -> DataFrame:
    """What every text's chunks must fulfil, measured on each: their size, that they stand in the
    text, begin and end with it, hold all of its characters and repeat no more than the overlap."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.recursive_chunks(docs, "doc_id")

    def bare(text: Column) -> Column:
        return F.length(F.regexp_replace(text, r"\s+", ""))

    whole = F.regexp_replace("text", r"^\s+|\s+$", "")
    each = chunks.join(docs, "doc_id")
    return (
        each.groupBy("doc_id")
        .agg(
            F.max(bare(F.col("text"))).cast("bigint").alias("text_chars"),
            F.bool_and(F.col("char_count") <= chunking.CHUNK_SIZE).alias("in_size"),
            F.bool_and(F.contains("text", "content")).alias("in_text"),
            F.bool_and(
                (F.col("chunk_index") > 0) | F.startswith(whole, F.col("content"))
            ).alias("in_order"),
            F.sum(bare(F.col("content"))).alias("_held"),
            F.count(F.lit(1)).alias("_chunks"),
        )
        .select(
            "doc_id", "text_chars", "in_size", "in_text", "in_order",
            (F.col("_held") >= F.col("text_chars")).alias("all_covered"),
            (
                F.col("_held") <= F.col("text_chars") + chunking.CHUNK_OVERLAP * (F.col("_chunks") - 1)
            ).alias("in_overlap"),
        )
    )


_PARAGRAPHS = """paragraphs AS (
  SELECT doc_id, i AS chunk_index, doc_id || '_chunk_' || i AS chunk_id,
         regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS content
  FROM (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)),
                 '\\r?\\n\\r?\\n'), lambda p: p <> '') AS parts FROM documents),
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""


def _document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").withColumn(
        "text", F.replace("text", F.lit("\n"), F.lit("\n\n"))
    )
    return chunking.paragraph_chunks(texts, "doc_id")


@query(
    "paragraph_chunks",
    f"""WITH {_PARAGRAPHS}
SELECT doc_id, chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index, content FROM paragraphs""",
)
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _document_paragraphs(spark, d)


@query(
    "chunk_stamping",
    f"""WITH {views.DECISIONS}
SELECT p.document_id, s.document_group_id, file_name, version, is_current, file_name AS source,
       'text' AS type, count(*) AS chunks, sum(length({views.STRIP.format('content')}))::BIGINT AS chars
FROM paragraphs p JOIN snapshot s ON p.document_id = s.id GROUP BY ALL""",
)
def chunk_stamping(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot_and_chunks(spark, d)[1].groupBy(
        "document_id", "document_group_id", "file_name", "version", "is_current", "source", "type"
    ).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


_SEARCH = f"""{views.CENTROIDS}, {views.VECTOR_CHUNKS},
hits AS (
  SELECT *, row_number() OVER (PARTITION BY archetype_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM (SELECT a.archetype_id, c.chunk_id, file_name, content,
               round(list_cosine_similarity(a.embedding, c.embedding::DOUBLE[]), 6) AS similarity
        FROM centroids a, chunks c WHERE is_current))"""


def _search(spark: SparkSession, d: str) -> DataFrame:
    queries = views.centroids(spark, d)
    return ops.active_chunk_search(queries, views.vector_chunks(spark, d), "archetype_id")


@query(
    "active_chunk_search",
    f"""WITH {_SEARCH} SELECT archetype_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank
FROM hits WHERE rank <= 4""",
)
def active_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)


@query(
    "citations",
    f"""WITH {_SEARCH}
SELECT archetype_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank, file_name, 1 AS version,
       md5(CAST(chunk_id AS VARCHAR)) AS document_id, 'text' AS type, 0 AS chunk_index,
       {views.STRIP.format("replace(substr(content, 1, 250), chr(10), ' ')")} AS excerpt
FROM hits WHERE rank <= 4""",
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    return ops.citations(_search(spark, d), views.vector_chunks(spark, d))


@query(
    "keyword_search",
    f"""WITH {_PARAGRAPHS},
asked AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS words
          FROM benchmark),
scored AS (
  SELECT item_id, chunk_id, CASE WHEN len(words) = 0 THEN 0.5 ELSE
    len(list_filter(words, lambda w: contains(t, w)))::DOUBLE / len(words) END AS score
  FROM asked, (SELECT chunk_id, lower(content) AS t FROM paragraphs))
SELECT item_id, chunk_id, score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 3""",
)
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").withColumnRenamed("text", "query")
    return ops.keyword_top_k(asked, _document_paragraphs(spark, d), "item_id")


@query(
    "page_range_text",
    f"""WITH {views.BOOK_PAGES},
parts AS (
  SELECT source_id, chunk_index, '--- Trang ' || page_number || ' [C' || page_number % 6 || ' | L'
         || page_number % 5 || ' | P' || page_number % 4 || '] ---' || chr(10) || text || chr(10) AS part
  FROM book_pages WHERE page_number BETWEEN 2 AND 1000000),
sized AS (SELECT *, sum(length(part)) OVER (PARTITION BY source_id ORDER BY chunk_index) AS so_far FROM parts)
SELECT source_id AS request_id, chunk_index, part, CAST(so_far AS BIGINT) AS chars_so_far FROM sized""",
)
def page_range_text(spark: SparkSession, d: str) -> DataFrame:
    pages = views.book_pages(spark, d).select(
        "source_id", "page_number", "chunk_index", "text",
        *[
            F.concat(F.lit(letter), (F.col("page_number") % n).cast("string")).alias(name)
            for letter, n, name in (
                ("C", 6, "chapter_name"), ("L", 5, "lesson_name"), ("P", 4, "pattern_name")
            )
        ],
    )
    wanted = pages.select("source_id").distinct().select(
        F.col("source_id").alias("request_id"),
        "source_id",
        F.lit(2).alias("start_page"),
        F.lit(1_000_000).alias("end_page"),
    )
    return ops.page_range_text(pages, wanted)
