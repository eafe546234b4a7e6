"""Merging the batches an exam was read in: best questions, stitched passages, keys and images.

``questions``: exam_id, question_number, arrival (rising in the order read), page_number, content,
options (map), correct_option, explanation, difficulty_level, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import contains_any, is_blank, strip
from gradus.operators.ordered import bucket_of, dense_index
from gradus.session import stacked, stored

# Weights of completeness, difficulty range and default, size of a block of numbers.
CONTENT_CAP, EXPLANATION_WEIGHT, OPTION_WEIGHT = 400, 300, 60
DIFFICULTY_DEFAULT, DIFFICULTY_MIN, DIFFICULTY_MAX = 2, 1, 6
LETTERS = "ABCD"
NUMBERS_PER_BLOCK = 50


def correct_option(raw: Column) -> Column:
    """Letter of an answer key: a letter, an index from 0, a lone letter in the text, else A."""
    key = F.upper(strip(F.coalesce(raw, F.lit(""))))
    alone = F.regexp_extract(key, r"(?U)\b([A-D])\b", 1)
    leading = F.regexp_extract(key, r"^[(\[]?([A-D])", 1)
    return (
        F.when(key.isin(*LETTERS), key)
        .when(key.isin("0", "1", "2", "3"), F.translate(key, "0123", LETTERS))
        .when(alone != "", alone)
        .when(leading != "", leading)
        .otherwise("A")
    )


def correct_option_loose(raw: Column) -> Column:
    """As above with more tolerance: wrapped in punctuation, 4 for D, after a keyword, anywhere."""
    text = strip(F.coalesce(raw, F.lit("")))
    bare = F.upper(F.regexp_replace(text, r"""^[ \t\r\n.:();,\[\]'"]+|[ \t\r\n.:();,\[\]'"]+$""", ""))
    ended = F.upper(F.regexp_extract(text, r"(?iU)([a-d])\b", 1))
    any_letter = F.upper(F.regexp_extract(text, r"([A-Da-d])", 1))
    any_digit = F.regexp_extract(text, r"([0-4])", 1)
    return (
        F.when(bare.rlike("^[A-D]$"), bare)
        .when(bare.rlike("^[0-4]$"), F.translate(bare, "01234", LETTERS + "D"))
        .when(ended != "", ended)
        .when(any_letter != "", any_letter)
        .when(any_digit != "", F.translate(any_digit, "01234", LETTERS + "D"))
        .otherwise("A")
    )


def unreadable_keys(questions: DataFrame) -> DataFrame:
    """Questions whose key says nothing, and so became A."""
    key = F.upper(strip(F.coalesce(F.col("correct_option"), F.lit(""))))
    readable = key.rlike(r"(?U)^[0-3]$|\b[A-D]\b|^[(\[]?[A-D]")
    return questions.where(~readable)


def difficulty(level: Column) -> Column:
    known = F.when(F.coalesce(level, F.lit(0)) <= 0, DIFFICULTY_DEFAULT).otherwise(level)
    return F.greatest(F.lit(DIFFICULTY_MIN), F.least(F.lit(DIFFICULTY_MAX), known))


def quality(content: Column, explanation: Column, options: Column) -> Column:
    length = F.when(~is_blank(content), F.least(F.length(content), F.lit(CONTENT_CAP))).otherwise(0)
    told = F.when(~is_blank(explanation), EXPLANATION_WEIGHT).otherwise(0)
    filled = F.size(F.filter(F.map_values(options), lambda v: ~is_blank(v)))
    return length + told + F.coalesce(filled, F.lit(0)) * OPTION_WEIGHT


def merge_questions(questions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most complete version of each number; the earliest among equals. Partially aggregated, so
    copies of a question never meet in one place in full.

    ``columns`` are those to keep besides exam and number. Ask for what is needed only: the others are
    shuffled, too.
    """
    kept = questions.columns if columns is None else columns
    rest = [c for c in kept if c not in ("exam_id", "question_number")]
    made = {"correct_option": correct_option, "difficulty_level": difficulty}
    scored = questions.where("question_number > 0").withColumns(
        {
            **{c: make(F.col(c)) for c, make in made.items() if c in rest},
            "_score": quality(F.col("content"), F.col("explanation"), F.col("options")),
        }
    )
    best = scored.groupBy("exam_id", "question_number").agg(
        F.max_by(F.struct(*rest), F.struct("_score", -F.col("arrival"))).alias("_q")
    )
    merged = best.select(
        "exam_id", "question_number", *[F.col(f"_q.{c}").alias(c) for c in rest if c != "options"], "_q"
    )
    if "options" in rest:
        options = F.map_from_arrays(
            F.array(*[F.lit(x) for x in LETTERS]),
            F.array(*[F.coalesce(F.col("_q.options")[x], F.lit("")) for x in LETTERS]),
        )
        merged = merged.withColumn("options", options)
    return merged.drop("_q")


PASSAGE_KEYS = ["exam_id", "start_question", "end_question"]
_VALID_PASSAGE = "start_question > 0 and end_question >= start_question"


def passage_ranges(passages: DataFrame) -> DataFrame:
    """The keys of ``stitch_passages`` without its texts."""
    return passages.where(_VALID_PASSAGE).select(*PASSAGE_KEYS).distinct()


def figure_passages(passages: DataFrame) -> DataFrame:
    """(exam_id, start_question, end_question, wants_figure): what ``wants_figure`` says of the stitched
    text, found without stitching it.

    Stitching loses no text, at most its case: a part is left out where the text has it and replaces
    a text that it has, and parts are joined by a blank line, which none of the words holds. So a word is
    in the stitched text where it is in any part.
    """
    text = F.lower(F.coalesce("content", F.lit("")))
    seen = {
        "_pointed": contains_any(text, FIGURE_WORDS),
        "_trial": F.contains(text, F.lit("thí nghiệm")),
        "_figure": F.contains(text, F.lit("hình")),
        "_chart": contains_any(text, PASSAGE_CHARTS),
    }
    found = passages.where(_VALID_PASSAGE).groupBy(*PASSAGE_KEYS).agg(
        *[F.bool_or(hit).alias(name) for name, hit in seen.items()]
    )
    return found.select(
        *PASSAGE_KEYS, F.expr("(_pointed or (_trial and _figure)) and not _chart").alias("wants_figure")
    )


def stitch_passages(passages: DataFrame) -> DataFrame:
    """One passage per (exam, start, end) from its parts in order of arrival.

    A part that the text so far contains changes nothing, one that contains the text so far replaces
    it, any other is appended. Equal parts (ignoring case) therefore count once, and are reduced to
    the earliest before anything is brought together.
    """
    keys = PASSAGE_KEYS
    valid = passages.where(_VALID_PASSAGE).withColumn(
        "content", strip(F.coalesce("content", F.lit("")))
    )
    distinct = valid.groupBy(*keys, F.lower("content").alias("_form")).agg(
        F.min(F.struct("arrival", "content")).alias("_part"),
        F.min(F.when(~is_blank(F.col("image_url")), F.struct("arrival", "image_url"))).alias("_image"),
    )

    def add(text: Column, part: Column) -> Column:
        old, new = F.lower(text), F.lower(part)
        return (
            F.when(part == "", text)
            .when(text == "", part)
            .when(
                ~F.contains(old, new) & ~F.contains(new, old), F.concat(text, F.lit("\n\n"), part)
            )
            .when(F.length(part) > F.length(text), part)
            .otherwise(text)
        )

    return distinct.groupBy(*keys).agg(
        F.aggregate(
            F.sort_array(F.collect_list("_part")), F.lit(""), lambda acc, p: add(acc, p["content"])
        ).alias("content"),
        F.min("_image")["image_url"].alias("image_url"),
    )


def place_questions(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """Each question with the first passage, by (start, end), whose range holds it. ``questions`` has a
    number of an exam once, as ``merge_questions`` gives it.

    Ranges and numbers meet in blocks of fifty numbers of an exam, then exactly. A question is taken
    along through that join, so that its table is made and shuffled once.
    """
    block = F.floor(F.col("question_number") / NUMBERS_PER_BLOCK)
    first = F.floor(F.col("start_question") / NUMBERS_PER_BLOCK)
    last = F.floor(F.col("end_question") / NUMBERS_PER_BLOCK)
    ranges = passages.select(
        "exam_id", F.struct("start_question", "end_question").alias("_p"),
        F.explode(F.sequence(first, last)).alias("_block"),
    )
    held = F.col("question_number").between(F.col("_p.start_question"), F.col("_p.end_question"))
    rest = [c for c in questions.columns if c not in ("exam_id", "question_number")]
    owned = (
        questions.withColumn("_block", block)
        .join(ranges, ["exam_id", "_block"], "left")
        .groupBy("exam_id", "_block", "question_number")
        .agg(*[F.first(c).alias(c) for c in rest], F.min(F.when(held, F.col("_p"))).alias("_p"))
    )
    return owned.select(
        *questions.columns,
        F.col("_p.start_question").alias("passage_start"),
        F.col("_p.end_question").alias("passage_end"),
    )


def merged_totals(placed: DataFrame, passages: DataFrame, total_pages: DataFrame) -> DataFrame:
    q = placed.groupBy("exam_id").agg(
        F.count_if(F.col("passage_start").isNull()).alias("total_single_questions"),
        F.max("page_number").alias("_page"),
    )
    p = passages.groupBy("exam_id").agg(F.count(F.lit(1)).alias("total_passages"))
    zero = F.lit(0).cast("bigint")
    return total_pages.join(q, "exam_id", "left").join(p, "exam_id", "left").select(
        "exam_id",
        F.coalesce("total_passages", zero).alias("total_passages"),
        F.coalesce("total_single_questions", zero).alias("total_single_questions"),
        F.greatest("total_pages", F.coalesce("_page", F.lit(1)), F.lit(1)).alias("total_pages"),
    )


# Words that point to a figure, and those that mean a chart or table.
FIGURE_WORDS = [
    "hình vẽ", "hình bên", "hình dưới", "như hình", "ở hình", "hình 1", "hình 2", "hình 3",
    "hình a", "hình b", "[hình", "sơ đồ", "dụng cụ", "đồ thị như hình", "đồ thị ở hình",
    "đồ thị bên", "đồ thị dưới",
]
PASSAGE_CHARTS = [
    "biểu đồ cột", "biểu đồ tròn", "biểu đồ hình tròn", "bảng số liệu", "| --- |", "|:---|",
]
QUESTION_CHARTS = ["biểu đồ", "bảng số liệu", "| --- |"]


def wants_figure(content: Column, passage: bool) -> Column:
    text = F.lower(F.coalesce(content, F.lit("")))
    pointed = contains_any(text, FIGURE_WORDS)
    if passage:
        pointed = pointed | (F.contains(text, F.lit("thí nghiệm")) & F.contains(text, F.lit("hình")))
    charts = contains_any(text, PASSAGE_CHARTS if passage else QUESTION_CHARTS)
    return pointed & ~charts


def assign_images(passages: DataFrame, singles: DataFrame, images: DataFrame) -> DataFrame:
    """The n-th item of a page that points to a figure takes the n-th image of the page, top down.

    ``passages`` (start_question, end_question, page_number of their first question) come before
    ``singles``. Returns (exam_id, kind, item, page_number, url).
    """
    return place_images(
        passages.where(wants_figure(F.col("content"), True)),
        singles.where(wants_figure(F.col("content"), False)),
        images,
    )


def place_images(passages: DataFrame, singles: DataFrame, images: DataFrame) -> DataFrame:
    """``assign_images`` of items that are known to point to a figure; their texts are not needed."""
    p = passages.select(
        "exam_id", "page_number", F.lit("passage").alias("kind"),
        F.col("start_question").alias("item"),
        F.lit(0).alias("_turn"), F.col("start_question").alias("_order"),
        F.col("end_question").alias("_tie"),
    )
    s = singles.select(
        "exam_id", "page_number", F.lit("question").alias("kind"),
        F.col("question_number").alias("item"),
        F.lit(1).alias("_turn"), F.col("question_number").alias("_order"), F.lit(0).alias("_tie"),
    )
    page = ["exam_id", "page_number"]
    place = F.col("_turn") * (1 << 40) + F.col("_order")
    claims = dense_index(
        stored(stacked(p, s).where("page_number > 0")),
        page,
        [F.col("_turn"), F.col("_order"), F.col("_tie")],
        bucket_of(place),
    )
    queue = dense_index(
        images.select(*page, "y", "url"), page, [F.col("y"), F.col("url")], bucket_of(F.col("y"))
    )
    return claims.join(queue, [*page, "idx"]).select("exam_id", "kind", "item", "page_number", "url")
