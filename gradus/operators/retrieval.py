"""Vector and keyword search of whole query tables over whole chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import vectors
from gradus.functions.text import strip
from gradus.operators.blocks import slices
from gradus.operators.neighbours import nearest
from gradus.operators.ordered import bucket_of, running_sum
from gradus.operators.substrings import BROADCAST_GRAMS, containing, small
from gradus.session import checkpointed

DEFAULT_TOP_K = 4
KEYWORD_TOP_K = 3
EMPTY_QUERY_SCORE = 0.5
CITATION_CHARS = 250


def _ranked(found: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """Best k per key. The rank filter lets map tasks drop all but k rows per key beforehand."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


VECTOR_BYTES = "size(embedding) * 8 + 64"
#: Bytes of the smaller side that may be sent to all tasks; beyond it both meet in the cells of a metric.
BROADCAST_BYTES = 128 * 1024 * 1024


def vector_top_k(
    queries: DataFrame,
    bank: DataFrame,
    query_id: str,
    bank_id: str,
    k: int = DEFAULT_TOP_K,
    query_scope: str | None = None,
    bank_scope: str | None = None,
    bank_is_large: bool = False,
    broadcast_bytes: int | None = None,
    **cells: int,
) -> DataFrame:
    """Rows (query_id, bank_id, similarity, rank) of the exact k nearest by cosine.

    With scopes, only bank rows of the query's scope compete. The bank, or with ``bank_is_large`` the
    queries, are summed up first: if they are under ``broadcast_bytes`` the other side streams past
    them, otherwise both go through ``neighbours.nearest``, which takes ``cells``.
    """
    one = F.lit(0)
    q = queries.select(query_id, "embedding", (F.col(query_scope) if query_scope else one).alias("_scope"))
    b = bank.select(bank_id, "embedding", (F.col(bank_scope) if bank_scope else one).alias("_scope"))
    q, b = q.where("embedding is not null"), b.where("embedding is not null")
    if query_scope:
        q, b = q.where("_scope is not null"), b.where("_scope is not null")
    id_types = [df.schema[c].dataType.simpleString() for df, c in ((q, query_id), (b, bank_id))]
    schema = f"{query_id} {id_types[0]}, {bank_id} {id_types[1]}, similarity double"
    small, large = (q, b) if bank_is_large else (b, q)
    size = small.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(VECTOR_BYTES)).alias("bytes")).first()
    if not size["rows"]:
        found = q.sparkSession.createDataFrame([], schema)
    elif size["bytes"] <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        held = q.sparkSession.sparkContext.broadcast(small.toPandas())

        def stream(batches):
            for batch in batches:
                if len(batch):
                    left, right = (held.value, batch) if bank_is_large else (batch, held.value)
                    yield vectors.top_k(left, right, query_id, bank_id, k, "_scope", "_scope")

        found = large.mapInPandas(stream, schema)
    else:
        members = b.count() if bank_is_large else size["rows"]
        found = nearest(q, b, query_id, bank_id, k, members, **cells)
    return _ranked(found, query_id, "similarity", bank_id, k)


def active_chunk_search(
    queries: DataFrame, chunks: DataFrame, query_id: str, k: int = DEFAULT_TOP_K, **limits: int
) -> DataFrame:
    """Nearest chunks of current document versions only."""
    return vector_top_k(
        queries, chunks.where("is_current"), query_id, "chunk_id", k, bank_is_large=True, **limits
    )


def _word_hits(texts: pd.Series, words: list[str]) -> np.ndarray:
    """Which words occur, anywhere, in each text (rows) - one pass over a text for all words."""
    import ahocorasick

    hits = np.zeros((len(texts), len(words)), dtype=np.float64)
    if not words:
        return hits
    automaton = ahocorasick.Automaton()
    for j, word in enumerate(words):
        automaton.add_word(word, j)
    automaton.make_automaton()
    for i, text in enumerate(texts.fillna("")):
        hits[i, [j for _, j in automaton.iter(text)]] = 1.0
    return hits


#: Words of a query that are looked up first, candidates that then set the bar, and the share of the bar
#: that the looked-up words must bring.
FIRST_WORDS, FIRST_CANDIDATES, LOOKED_UP = 3, 8, 0.5


def keyword_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    query_id: str,
    text: str = "query",
    skill: str | None = None,
    k: int = KEYWORD_TOP_K,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank): share of the query's words found in the chunk.

    Words are not made distinct, and match anywhere in the chunk, ignoring case. A query without
    words scores 0.5 everywhere. Equal scores rank by chunk_id. With ``skill``, both tables carry
    that column and a query with one only sees chunks of the same skill.

    Queries whose summed size is under ``broadcast_bytes`` go to all tasks, which pass once over each
    chunk for all words; beyond it words and chunks meet in an index (``indexed_keywords``).
    """
    extra = [skill] if skill else []
    split = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    q = queries.select(query_id, split.alias("_words"), *extra)
    size = F.aggregate("_words", F.lit(64), lambda s, w: s + F.length(w) * 2 + 60)
    held_bytes = q.agg(F.sum(size)).first()[0] or 0
    if held_bytes > (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return indexed_keywords(queries, chunks, query_id, text, skill, k)
    c = chunks.select("chunk_id", F.lower("content").alias("_text"), *extra)
    types = [df.schema[n].dataType.simpleString() for df, n in ((q, query_id), (c, "chunk_id"))]
    schema = f"{query_id} {types[0]}, chunk_id {types[1]}, score double"

    def score(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        words = sorted({w for ws in held["_words"] for w in ws})
        place = {w: j for j, w in enumerate(words)}
        ordered = batch.sort_values("chunk_id", kind="stable")
        parts = [
            best
            for part in slices(ordered, len(words))
            for best in score_part(part, held, words, place)
        ]
        return pd.DataFrame(parts, columns=[query_id, "chunk_id", "score"])

    def score_part(part: pd.DataFrame, held: pd.DataFrame, words: list[str], place: dict):
        ids = part["chunk_id"].to_numpy()
        hits = _word_hits(part["_text"], words)
        for row in held.to_dict("records"):
            ws = row["_words"]
            if len(ws):
                values = hits[:, [place[w] for w in ws]].sum(axis=1) / len(ws)
            else:
                values = np.full(len(part), EMPTY_QUERY_SCORE)
            if skill and row[skill]:
                values[part[skill].str.lower().to_numpy() != row[skill].lower()] = -np.inf
            for _, _, cols, best in vectors.best_columns(values[None, :], k):
                if len(cols):
                    yield row[query_id], ids[cols[0]], best[0]

    shared = q.sparkSession.sparkContext.broadcast(q.toPandas())

    def stream(batches):
        for batch in batches:
            if len(batch):
                yield score(batch, shared.value)

    return _ranked(c.mapInPandas(stream, schema), query_id, "score", "chunk_id", k)


def indexed_keywords(
    queries: DataFrame, chunks: DataFrame, query_id: str, text: str, skill: str | None, k: int
) -> DataFrame:
    """``keyword_top_k`` without sending one side to the other's tasks.

    A word has no blank, so it stands in a chunk where it stands in one of the chunk's tokens. Which
    tokens hold which words comes from an index of grams over the distinct tokens (``substrings``), and
    chunks are found by their tokens, rare words first. A query's rarest words give a few candidates,
    whose whole scores set a bar: its k-th best. The commonest words, as many as bring less than half
    the bar, are then never looked up: a chunk that reaches the bar must have the other half from the
    words that are. Only such chunks are scored whole. The k first chunks by id are always scored, as a
    query may match nothing.
    """
    split = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    scope = F.nullif(F.lower(skill), F.lit("")) if skill else F.lit(None).cast("string")
    asked = checkpointed(queries.select(query_id, split.alias("_words"), scope.alias("_skill")))
    own = F.lower(skill) if skill else F.lit(None).cast("string")
    held = checkpointed(chunks.select("chunk_id", F.lower("content").alias("_text"), own.alias("_own")))

    words = asked.select(query_id, F.explode("_words").alias("phrase")).groupBy(query_id, "phrase").agg(
        F.count(F.lit(1)).alias("times")
    )
    tokens = held.select("chunk_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("token"))
    counted = checkpointed(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts")))
    pairs = checkpointed(containing(counted, "token", words.select("phrase").distinct()).join(counted, "token"))
    spread = pairs.groupBy("phrase").agg(F.sum("texts").alias("texts"))
    rare_first = Window.partitionBy(query_id).orderBy("texts", "phrase")
    ranked = checkpointed(
        words.join(small(spread, BROADCAST_GRAMS), "phrase").select(
            query_id, "phrase", "times",
            F.row_number().over(rare_first).alias("_n"),
            F.sum("times").over(rare_first.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
        )
    )

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs of a query and a chunk of its skill."""
        if not skill:
            return pairs
        skills = asked.select(query_id, "_skill")
        both = pairs.join(skills, query_id).join(held.select("chunk_id", "_own"), "chunk_id")
        return both.where("_skill IS NULL OR _skill = _own").drop("_skill", "_own")

    def found(wanted: DataFrame) -> DataFrame:
        """(query_id, chunk_id, matched) by the words of ``wanted`` (query_id, phrase, times)."""
        mine = pairs.join(wanted.select("phrase").distinct(), "phrase", "left_semi")
        by_token = mine.groupBy("token").agg(F.collect_list("phrase").alias("_p"))
        met = tokens.join(small(checkpointed(by_token), BROADCAST_GRAMS), "token").groupBy("chunk_id").agg(
            F.array_distinct(F.flatten(F.collect_list("_p"))).alias("_p")
        )
        return (
            met.select("chunk_id", F.explode("_p").alias("phrase"))
            .join(small(wanted, BROADCAST_GRAMS), "phrase")
            .groupBy(query_id, "chunk_id")
            .agg(F.sum("times").alias("matched"))
        )

    def scored(pairs: DataFrame) -> DataFrame:
        whole = pairs.join(asked.select(query_id, "_words"), query_id).join(held.select("chunk_id", "_text"), "chunk_id")
        matched = F.size(F.filter("_words", lambda w: F.contains(F.col("_text"), w)))
        return whole.select(query_id, "chunk_id", matched.alias("matched"), F.size("_words").alias("_size"))

    first_ids = Window.partitionBy("_own").orderBy("chunk_id")
    fillers = held.select("chunk_id", "_own").withColumn("_n", F.row_number().over(first_ids)).where(F.col("_n") <= k)
    everywhere = fillers.orderBy("chunk_id").limit(k).select("chunk_id", F.lit(None).cast("string").alias("_skill"))
    if skill:
        everywhere = everywhere.unionByName(fillers.where("_own IS NOT NULL").select("chunk_id", F.col("_own").alias("_skill")))
    filled = asked.join(
        everywhere.withColumnRenamed("_skill", "_s"), F.col("_skill").eqNullSafe(F.col("_s"))
    ).select(query_id, "chunk_id")

    best = Window.partitionBy(query_id).orderBy(F.desc("matched"), "chunk_id")
    opened = allowed(found(ranked.where(F.col("_n") <= FIRST_WORDS)))
    opened = opened.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= FIRST_CANDIDATES * k)
    known = checkpointed(scored(opened.select(query_id, "chunk_id").unionByName(filled).distinct()))
    at = known.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    bar = at.groupBy(query_id).agg(
        F.greatest(F.lit(1), F.when(F.count(F.lit(1)) == k, F.min("matched")).otherwise(0)).alias("_bar")
    )
    wanted = ranked.join(bar, query_id).where(F.col("_rest") >= LOOKED_UP * F.col("_bar"))
    # What the words that are not looked up can add at most.
    unseen = ranked.join(bar, query_id).where(F.col("_rest") < LOOKED_UP * F.col("_bar"))
    unseen = unseen.groupBy(query_id).agg(F.max("_rest").alias("_unseen"))
    reached = (
        found(wanted.select(query_id, "phrase", "times"))
        .join(bar.join(unseen, query_id, "left"), query_id)
        .where(F.col("matched") + F.coalesce("_unseen", F.lit(0)) >= F.col("_bar"))
        .select(query_id, "chunk_id")
    )
    more = scored(allowed(reached).join(known.select(query_id, "chunk_id"), [query_id, "chunk_id"], "left_anti"))
    empty = F.lit(EMPTY_QUERY_SCORE)
    score = F.when(F.col("_size") == 0, empty).otherwise(F.col("matched") / F.col("_size"))
    rows = known.unionByName(more).select(query_id, "chunk_id", score.alias("score"))
    return _ranked(rows, query_id, "score", "chunk_id", k)


def citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is shown as the source of a retrieved chunk."""
    excerpt = strip(F.translate(F.substring("content", 1, CITATION_CHARS), "\n", " "))
    sources = chunks.select(
        "chunk_id", "file_name", "version", "document_id", "type", "chunk_index",
        excerpt.alias("excerpt"),
    )
    return hits.join(sources, "chunk_id")


def page_range_text(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Text of a range of pages of a source, as rows in order: nothing is cut or brought together.

    ``requests``: request_id, source_id, start_page, end_page. ``chunks`` need a chunk_index that is
    unique and rising in a source. A row is a chunk under its header line, with the number of
    characters of the request's text up to and including it, by which a reader may stop.
    """
    header = F.format_string(
        "--- Trang %d [%s | %s | %s] ---",
        "page_number", "chapter_name", "lesson_name", "pattern_name",
    )
    wanted = (
        chunks.join(requests, "source_id")
        .where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
        .withColumn("part", F.concat(header, F.lit("\n"), "text", F.lit("\n")))
    )
    sized = running_sum(
        wanted,
        ["request_id"],
        [F.col("chunk_index")],
        bucket_of(F.col("chunk_index")),
        {"chars_so_far": F.length("part")},
    )
    return sized.select("request_id", "chunk_index", "part", "chars_so_far")
