"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated without labels.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains (0). Votes are
counted by pattern, of which there are at most 3 to the number of rules, and expectation
maximisation runs over the counted patterns: it estimates the share of good texts and, for each
rule, how often it votes good on good texts and bad on bad ones. A text is kept if the posterior
probability that it is good, given its votes, is at least ``threshold`` and no base check failed.

All of it is built-in columns: votes from one pass over each text, the estimation as a fold over
the one row of pattern counts. Patterns with their posteriors are broadcast; 3 ** 8 rows bound them.

A null text has no words and fails the base check, as do texts of under ten words; null ids and
repeated rows are rows like others; an empty table gives an empty result. Only the id and the text
column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.session import checkpointed

MIN_WORDS = 10
MAX_REPEATED = 0.2
WINDOW = 5
THRESHOLD = 0.5
ROUNDS = 25
#: Where the estimation starts, which counts as one text more and fades with their number: most texts are
#: good, a rule is rarely wrong on good texts and knows its own kind of bad texts, not every kind.
#: A weight above 0 makes the start count as so many times all votes.
START_GOOD, START_YES, START_NO = 0.8, 0.95, 0.4
PRIOR_WEIGHT = 0.0
N_RULES = 8

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _fresh(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def measured(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, measurements) of each row. Steps are kept apart so that none is computed twice."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    docs = _fresh(
        docs,
        words=F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""),
        lines=F.split("text", "\n"),
    )
    docs = _fresh(
        docs,
        n_words=F.size("words").cast("bigint"),
        word_chars=F.length(F.translate("text", _BLANKS, "")).cast("bigint"),
        n_symbols=(F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("bigint"),
        lines=F.filter("lines", lambda line: F.length(F.translate(line, _BLANKS, "")) > 0),
        hashes=F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - WINDOW),
                lambda at: F.xxhash64(*[F.get("words", at + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
        n_short=F.size(F.filter("words", lambda w: F.length(w) <= 3)),
        n_marked=F.size(F.filter("words", lambda w: w.rlike(r"[#*$%&|<>!]"))),
        n_runs=F.regexp_count("text", F.lit(r"([^\p{L}\p{N}\s.-])\1")),
        n_upper=F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")),
        n_lower=F.length(F.regexp_replace("text", r"[^\p{Ll}]+", "")),
    )
    docs = _fresh(
        docs,
        n_lines=F.size("lines"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        n_ended=F.size(F.filter("lines", lambda line: line.rlike(r"[.!?…:;\"”»)][ \t\r]*$"))),
        placed=F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, at: F.struct(h.alias("h"), at.alias("at")))),
        ),
    )
    # Windows found more than once stand next to each other in hash order.
    docs = docs.select("doc_id", *_MEASURES, "placed")
    twice = F.filter(
        "placed",
        lambda w, k: F.coalesce(F.get("placed", k - 1)["h"] == w["h"], F.lit(False))
        | F.coalesce(F.get("placed", k + 1)["h"] == w["h"], F.lit(False)),
    )
    docs = _fresh(docs, starts=F.when(F.col("placed").isNotNull(), twice))
    docs = _fresh(docs, starts=F.sort_array(F.transform("starts", lambda w: w["at"])))
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda at, k: F.least(F.coalesce(F.get("starts", k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)),
        ),
        F.lit(0),
        lambda total, words: total + words,
    )
    docs = _fresh(docs, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("bigint"))
    return docs.drop("placed", "starts")


_MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ended", "n_short",
    "n_marked", "n_runs", "n_upper", "n_lower",
)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(part), whole), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Each rule's vote on the measurements."""
    words, lines = F.col("n_words"), F.col("n_lines")
    symbols = _share("n_symbols", F.col("word_chars"))
    marked, runs = _share("n_marked", words), _share("n_runs", words)
    repeated = _share("n_repeat_words", words)
    twice = _share("n_dup_lines", lines)
    capitals = _share("n_upper", F.col("n_upper") + F.col("n_lower"))
    short = _share("n_short", words)
    ended = _share("n_ended", lines)
    enough = words >= 30
    return {
        "symbols": _vote(symbols < 0.01, symbols > 0.05),
        "marked_words": _vote(marked < 0.05, marked > 0.2),
        "runs_of_marks": _vote(runs < 0.01, runs > 0.05),
        "repetition": _vote(repeated < 0.02, repeated > MAX_REPEATED / 2),
        "lines": _vote((twice == 0) & (lines > 1), twice > 0.3),
        "capitals": _vote(capitals < 0.15, capitals > 0.4),
        "short_words": _vote((short >= 0.15) & (short <= 0.7), ((short < 0.1) | (short > 0.85)) & enough),
        "endings": _vote(ended >= 0.8, (ended < 0.3) & enough),
    }


def base_failed() -> Column:
    limit = int(100 * MAX_REPEATED)
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > limit * F.col("n_words")
    )


def judged(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements, base_failed and the votes as an array."""
    return measured(df, id_column, text_column).select(
        "*",
        base_failed().alias("base_failed"),
        F.array(*[v.cast("tinyint") for v in rules().values()]).alias("votes"),
    )


def _log_odds(votes: str, state: str) -> str:
    """Log of P(good | votes) / P(bad | votes): prior odds times each voting rule's odds."""
    return f"""aggregate(sequence(0, {N_RULES - 1}), ln({state}.good / (1 - {state}.good)),
      (total, r) -> total + CASE get({votes}, r)
        WHEN 1 THEN ln(get({state}.yes, r) / (1 - get({state}.no, r)))
        WHEN -1 THEN ln((1 - get({state}.yes, r)) / get({state}.no, r)) ELSE 0D END)"""


def _posterior(votes: str, state: str) -> str:
    return f"1 / (1 + exp(-greatest(-700D, least(700D, {_log_odds(votes, state)}))))"


def _sum(value: str) -> str:
    return f"aggregate(seen, 0D, (total, p) -> total + ({value}))"


def estimated(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: ``state`` (good, yes, no: share of good texts, each rule's two accuracies) and
    ``patterns`` (votes and how many texts gave them)."""
    counted = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    # One row for each pattern, of which there are 3 ** rules at most.
    folded = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    mass = {"yes": "p.n * p.q", "no": "p.n * (1 - p.q)"}

    def accuracy(kind: str, vote: int, start: float) -> str:
        prior = f"({PRIOR_WEIGHT}D * {_sum(mass[kind])} + 1)"
        return f"""transform(sequence(0, {N_RULES - 1}), r -> (
          {_sum(f"{mass[kind]} * CAST(get(p.votes, r) = {vote} AS DOUBLE)")} + {start}D * {prior}) / (
          {_sum(f"{mass[kind]} * CAST(get(p.votes, r) <> 0 AS DOUBLE)")} + {prior}))"""

    yes, no = accuracy("yes", 1, START_YES), accuracy("no", -1, START_NO)
    good = f"({_sum(mass['yes'])} + {START_GOOD}D) / ({_sum('CAST(p.n AS DOUBLE)')} + 1)"
    start = f"""named_struct('good', {START_GOOD}D,
      'yes', array_repeat({START_YES}D, {N_RULES}), 'no', array_repeat({START_NO}D, {N_RULES}))"""
    step = f"""element_at(transform(
      array(transform(patterns, p -> named_struct(
        'votes', p.votes, 'n', p.n, 'q', {_posterior("p.votes", "state")}))),
      seen -> named_struct('good', {good}, 'yes', {yes}, 'no', {no})), 1)"""
    state = f"aggregate(sequence(1, {rounds}), {start}, (state, round) -> {step})"
    return folded.select("patterns", F.expr(state).alias("state"))


def posteriors(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, p_good) of every pattern of votes that occurs."""
    each = estimated(votes, rounds).select("state", F.explode("patterns").alias("p"))
    return each.select(
        F.col("p.votes").alias("pattern"),
        F.expr(_posterior("p.votes", "state")).alias("p_good"),
    )


def assessed(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Measurements, votes, p_good and kept of each row."""
    rows = checkpointed(judged(df, id_column, text_column))
    known = posteriors(rows.select("votes"), rounds)
    return (
        rows.join(F.broadcast(known), F.col("votes") == F.col("pattern"))
        .drop("pattern")
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def good_documents(
    df: DataFrame, text_column: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS
) -> DataFrame:
    """The rows of ``df`` that are kept, columns unchanged.

    The votes are made once for the estimation and once more to select, so that texts neither
    leave their partition nor are stored in between. The base check is part of the join's key, not
    a filter: a filter would be moved below the measurements, which it would then repeat.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    packed = df.select(F.struct(*columns).alias("row"), F.col(f"`{text_column}`").alias("text"))
    known = posteriors(judged(packed, "text", "text").select("votes"), rounds)
    passing = checkpointed(known.where(F.col("p_good") >= threshold).select("pattern"))
    failed = F.array(F.col("base_failed").cast("tinyint"))
    no = F.array(F.lit(0).cast("tinyint"))
    return (
        judged(packed, "row", "text")
        .select("doc_id", F.concat("votes", failed).alias("_key"))
        .join(F.broadcast(passing.select(F.concat("pattern", no).alias("_pass"))), F.expr("_key = _pass"))
        .select("doc_id.*")
    )


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    return assessed(read(spark, base, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "p_good", "votes",
    )
