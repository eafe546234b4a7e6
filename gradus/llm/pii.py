"""Personal data: base patterns, and boosted trees that choose among further candidate spans.

Base spans are the matches of four patterns that pass a check of their digits. Wider generators then
propose spans of the same kinds, among them numbers without a country code and addresses written
out; they may overlap each other and the base. A candidate is described by its format (digits,
groups, separators) and its context (words before, characters around), not by what the base decides
on (the plus sign, the check digit, the size of the parts). Gradient-boosted trees learn from a
bounded sample of candidates which of them the base confirms, so formats and contexts like those of
confirmed spans score high. For each kind the threshold is the lowest at which, on the candidates
not learned from, the share that the base confirms is ``PRECISION``; without one nothing is added.
Where spans overlap, base spans stay, and of other candidates the most probable one of a run of
overlapping spans if it touches no base span.

All of it is built-in columns and Spark's own boosted trees; texts are read once, and what is kept
of them are the matches and a few characters around.

Null texts are empty; a row gives one row, repeated rows, null ids and rows without spans too; an
empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.registry import query, read
from gradus.session import checkpointed

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Possessive repeats and the limits on where a match may start change no match;
#: they keep long runs of one kind of character linear. \G is the end of the previous match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wide generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?"
    r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.,])[0-9]{1,3}(?:\x20?[.,:]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.\x2F-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])\+?\(?[0-9](?:[\x20().\x2F-]{0,3}[0-9]){6,14}(?![0-9])",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {
    "email": r"@|(?:\(| |\[)at(?:\)| |\])",
    "ip": r"[0-9]\x20?[.,:]\x20?[0-9]",
    "card": r"[0-9][\x20.\x2F-]?[0-9]",
    "phone": r"[0-9]",
}
BEFORE, AFTER = 24, 8
#: Words before a span, by what they speak for.
CONTEXT = {
    "call": r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell|contact|sms|whatsapp|telefon|tél|teléfono)\b",
    "mail": r"(?i)\b(e-?mail|mail|write|contact|correo|courriel)\b",
    "pay": r"(?i)\b(card|visa|credit|debit|mastercard|amex|karte|carte|tarjeta)\b",
    "host": r"(?i)\b(ip|host|server|address|addr|ping|subnet)\b",
    "count": r"(?i)\b(id|no|nr|number|ref|invoice|order|version|page|isbn|total|price|year)\b",
}

MAX_SAMPLE = 20_000
PRECISION = 0.95
TREES, DEPTH, SEED = 12, 3, 11


def _hits(text: Column, kind: str, pattern: str) -> tuple[Column, Column]:
    """(pieces between matches, matches), empty where the pattern cannot match."""
    none = F.array().cast("array<string>")
    possible = text.rlike(NEEDS[kind])
    pieces = F.when(possible, F.split(text, pattern, -1)).otherwise(none)
    hits = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return pieces, hits


def matches(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (row, doc_id, base, kind, start, end, hit, before, after); one of nulls for a text
    without any. ``row`` numbers the rows of ``df``."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    docs = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_column}`").alias("doc_id"),
        text.alias("text"),
    )
    names, columns = [], {}
    for base, patterns in ((True, BASE), (False, WIDE)):
        for kind in KINDS:
            name = f"{kind}_{base}"
            names.append((name, kind, base))
            pieces, hits = _hits(F.col("text"), kind, patterns[kind])
            columns |= {f"pieces_{name}": pieces, f"hits_{name}": hits}
    docs = docs.select("row", "doc_id", *[c.alias(n) for n, c in columns.items()])

    def found(name: str, kind: str, base: bool) -> Column:
        pieces = F.col(f"pieces_{name}")
        return F.transform(
            F.col(f"hits_{name}"),
            lambda hit, k: F.struct(
                F.lit(base).alias("base"),
                F.lit(kind).alias("kind"),
                k.alias("nth"),
                F.length(F.get(pieces, k)).alias("gap"),
                hit.alias("hit"),
                F.right(F.get(pieces, k), F.lit(BEFORE)).alias("before"),
                F.left(F.get(pieces, k + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    every = F.concat(*[found(*n) for n in names])
    rows = docs.select("row", "doc_id", F.explode_outer(every).alias("m")).select("row", "doc_id", "m.*")
    line = Window.partitionBy("row", "base", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("hit")).over(line)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))


def confirmed() -> Column:
    """Whether a base match passes its check."""
    hit, kind = F.col("hit"), F.col("kind")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    part = F.forall(
        F.split(hit, r"\."),
        lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int") <= 255, p.rlike("^0+$")),
    )
    count = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", part)
        .when(kind == "card", count.between(13, 19) & F.call_function("luhn_check", F.left(digits, F.lit(19))))
        .otherwise(count.between(9, 15))
    )


def _features() -> dict[str, Column]:
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    bare = F.regexp_replace(hit, r"^\+", "")
    groups = F.regexp_extract_all(bare, F.lit("[0-9]+"), F.lit(0))

    def count(marks: str) -> Column:
        return F.length(bare) - F.length(F.translate(bare, marks, ""))

    values = {f"kind_{k}": F.col("kind") == k for k in KINDS}
    values |= {
        "length": F.length(bare),
        "digits": F.length(F.regexp_replace(bare, "[^0-9]", "")),
        "groups": F.size(groups),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)),
        "dots": count("."),
        "dashes": count("-"),
        "blanks": count(" "),
        "brackets": count("()[]"),
        "commas": count(",:/"),
        "at": F.length(hit) - F.length(F.translate(hit, "@", "")),
        "letter_before": before.rlike(r"[\p{L}_]$"),
        "blank_before": before.rlike(r"(^|\s)$"),
        "sign_before": before.rlike(r"[=#$€£\"'/-]$"),
        "letter_after": after.rlike(r"^[\p{L}_]"),
        "unit_after": after.rlike(r"^\s?(%|€|\$|kg|km|cm|mm|\")"),
    }
    values |= {f"near_{name}": before.rlike(pattern) for name, pattern in CONTEXT.items()}
    return {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in values.items()}


def scored(candidates: DataFrame) -> DataFrame | None:
    """``candidates`` (with ``label``) and their ``p``; None if the labels do not differ.

    The sample that the trees are fitted on has ``MAX_SAMPLE`` candidates at most, drawn by hash.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = list(_features())
    described = VectorAssembler(inputCols=names, outputCol="features").transform(
        candidates.withColumns(_features())
    )
    draw = F.xxhash64("doc_id", "start", "kind", F.lit(SEED))
    learned = described.withColumn("_draw", draw).where("pmod(_draw, 2) = 0")
    fitted = learned.orderBy("_draw", "row").select("features", "label").limit(MAX_SAMPLE)
    fitted = checkpointed(fitted.coalesce(1))
    if fitted.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1, stepSize=0.3
    ).fit(fitted)
    return (
        trees.transform(described.withColumn("held_out", F.pmod(draw, F.lit(2)) == 1))
        .withColumn("p", vector_to_array("probability")[1])
        .select(*candidates.columns, "held_out", "p")
    )


def thresholds(rated: DataFrame) -> dict[str, float]:
    """Of each kind the lowest hundredth from which on ``PRECISION`` of the held-out candidates are
    confirmed; from the counts of 101 steps for each kind."""
    step = F.floor(F.col("p") * 100).alias("step")
    counts = (
        rated.where("held_out")
        .groupBy("kind", step)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
        .collect()
    )
    limits = {}
    for kind in KINDS:
        n = hits = 0
        for row in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.step):
            n, hits = n + row.n, hits + row.hits
            if hits >= PRECISION * n:
                limits[kind] = row.step / 100
    return limits


def spans(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, base, p): base spans and chosen candidates; a row of nulls
    for a text with neither."""
    every = checkpointed(matches(df, id_column, text_column))
    rows = every.select("row", "doc_id").distinct()
    base = every.where("base").where(confirmed())
    wide = every.where("NOT base")
    # Both lists of a kind are free of overlaps in themselves: spans that start nearest decide.
    line = Window.partitionBy("row", "kind").orderBy("start", F.col("base").desc())
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    merged = wide.withColumn("ok", F.lit(False)).unionByName(base.withColumn("ok", F.lit(True)))
    labelled = (
        merged.withColumn("_until", F.max(F.when(F.col("ok"), F.col("end"))).over(past))
        .withColumn("_next", F.min(F.when(F.col("ok"), F.col("start"))).over(
            line.rowsBetween(1, Window.unboundedFollowing)))
        .where("NOT ok")
        .withColumn(
            "label",
            (F.coalesce(F.col("_until") > F.col("start"), F.lit(False))
             | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))).cast("double"),
        )
        .drop("_until", "_next", "ok")
    )
    rated = scored(checkpointed(labelled))
    chosen = base.withColumn("p", F.lit(1.0))
    if rated is not None:
        rated = checkpointed(rated)
        limits = thresholds(rated)
        enough = reduce(
            lambda a, b: a | b,
            [(F.col("kind") == k) & (F.col("p") >= t) for k, t in limits.items()],
            F.lit(False),
        )
        chosen = chosen.unionByName(rated.where(enough).select(*chosen.columns))
    # Runs of overlapping spans of any kind; base spans stay, else the most probable one.
    line = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind", "base")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    runs = chosen.withColumn(
        "_new", F.coalesce((F.max("end").over(past) <= F.col("start")).cast("int"), F.lit(1))
    ).withColumn("_run", F.sum("_new").over(line))
    run = Window.partitionBy("row", "_run")
    best = F.row_number().over(run.orderBy(F.col("base").desc(), F.col("p").desc(), "start", "kind"))
    kept = runs.withColumn("_best", best).where("base OR _best = 1")
    kept = kept.select("row", "kind", "start", "end", "base", "p")
    return rows.join(kept, "row", "left")


def digest_columns(found: DataFrame) -> DataFrame:
    """One row for each text: counts of base spans, digest of base spans, all spans as text."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(order.alias("o"), "start", "end", "kind", "base")
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"),
    )

    def joined(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("all", lambda s: s["base"])

    def count(kind: str) -> Column:
        own = F.filter("all", lambda s: s["base"] & (s["kind"] == kind))
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return grouped.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans")
    )


def redacted(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) as an array of (start, end, kind) for each text, in text order."""
    found = spans(df, id_column, text_column)
    span = F.struct("start", "end", "kind")
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"),
    ).drop("row")


@query("op5_pii")
def op5_pii(spark: SparkSession, base: str) -> DataFrame:
    return digest_columns(spans(read(spark, base, "documents")))
