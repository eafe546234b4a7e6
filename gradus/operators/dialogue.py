"""Labels and audits of tutoring dialogue, as columns of a table of turns.

Turns: conv_id, turn (unique in a conversation), role, text; asks add question_latex and, where
known, options, correct_option and the history before them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.markers import Markers
from gradus.functions.text import contains_any, is_blank, mentions, normalised, strip, words
from gradus.operators.ordered import bucket_of, dense_index, preceding_rows

# History limits, tests for a foreign problem, role names.
HISTORY_TURNS = 6
PROBLEM_CHARS, MATH_SIGNS, MAX_OVERLAP = 25, 3, 0.2
MATH_SIGN = r"(?U)[=^\\$∫≤≥√π]|\d"
TUTOR_ROLES = ["tutor", "ai", "assistant", "model"]
OPTION_MENTION = r"(?U)(?<!\w)[abcd](?!\w)"
TASKLESS = ["C1", "C5"]
GREETING_CHARS, LONG_OPTION, MIN_OPTIONS = 20, 15, 3
DEFAULT_MARKERS = Markers()


def has_task(question: Column, query: Column, markers: Markers = DEFAULT_MARKERS) -> Column:
    """Whether a real item is on screen: not a placeholder, and not the query copied."""
    stem, asked = normalised(question), normalised(query)
    return ~stem.isin(*markers.placeholders) & ~((asked != "") & (stem == asked))


def speaker(role: Column) -> Column:
    return F.when(F.lower(F.coalesce(role, F.lit(""))).isin(*TUTOR_ROLES), "tutor").otherwise(
        "student"
    )


def with_history(
    turns: DataFrame, count: int = HISTORY_TURNS, chars: int | None = None
) -> DataFrame:
    """Adds ``history``: the last turns that are not blank before each, oldest first.

    Blank turns drop out. Turns are whole unless ``chars`` says how much of each to show. A
    conversation of any length is split over tasks.
    """
    said = turns.where(~is_blank(F.col("text")))
    bucket = bucket_of(F.col("turn"))
    placed = dense_index(said, ["conv_id"], [F.col("turn")], bucket, "_index")
    text = strip(F.col("text"))
    if chars is not None:
        text = F.substring(text, 1, chars)
    item = F.struct(speaker(F.col("role")).alias("role"), text.alias("text"))
    return preceding_rows(placed, ["conv_id"], "_index", count, item, "history").drop("_index")


def looks_like_problem(query: Column, markers: Markers = DEFAULT_MARKERS) -> Column:
    signs = F.size(F.regexp_extract_all(query, F.lit(f"({MATH_SIGN})"), F.lit(1)))
    return (F.length(query) >= PROBLEM_CHARS) & (
        (signs >= MATH_SIGNS) | mentions(query, list(markers.problem))
    )


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct words that b has; 0 if either has none."""
    mine, other = F.array_distinct(words(a)), F.array_distinct(words(b))
    share = F.size(F.array_intersect(mine, other)) / F.size(mine)
    return F.when((F.size(mine) > 0) & (F.size(other) > 0), share).otherwise(0.0)


def mood(query: Column, markers: Markers = DEFAULT_MARKERS) -> Column:
    return (
        F.when(mentions(query, list(markers.skeptic)), "SKEPTICAL")
        .when(mentions(query, list(markers.frustrated)), "FRUSTRATED")
        .when(F.contains(query, F.lit("?")) | mentions(query, list(markers.curious)), "CURIOUS")
        .otherwise("NEUTRAL")
    )


def focus(category: Column, query: Column, markers: Markers = DEFAULT_MARKERS) -> Column:
    return (
        F.when(category == "C1", "PERSONA")
        .when(category == "C3", "EXAM_VALIDITY")
        .when((category == "C5") | mentions(query, list(markers.step)), "STEP_HINT")
        .otherwise("CONCEPT_EXPLANATION")
    )


def category(
    question: Column, query: Column, has_history: Column, markers: Markers = DEFAULT_MARKERS
) -> Column:
    asked = normalised(query)
    task = has_task(question, query, markers)
    persona = mentions(asked, list(markers.persona))
    attitude = (
        persona
        | mentions(asked, list(markers.skeptic))
        | mentions(asked, list(markers.frustrated))
    )
    on_task = mentions(asked, list(markers.task)) | asked.rlike(OPTION_MENTION) | has_history
    problem = looks_like_problem(asked, markers)
    foreign = problem & (overlap(asked, normalised(question)) < MAX_OVERLAP)
    with_task = (
        F.when(asked == "", "C4")
        .when(mentions(asked, list(markers.validity)), "C3")
        .when(foreign, "C5")
        .when(attitude & on_task, "C2")
        .when(persona & ~has_history, "C1")
        .otherwise("C4")
    )
    without = F.when(problem | mentions(asked, list(markers.knowledge)), "C5").otherwise("C1")
    return F.when(task, with_task).otherwise(without)


def label(asks: DataFrame, markers: Markers = DEFAULT_MARKERS) -> DataFrame:
    """Adds has_task_context, category, student_mood and target_focus to asks (question_latex, query,
    history)."""
    has_history = F.coalesce(F.size("history") > 0, F.lit(False))
    asked = normalised(F.col("query"))
    return (
        asks.withColumn(
            "has_task_context", has_task(F.col("question_latex"), F.col("query"), markers)
        )
        .withColumn(
            "category", category(F.col("question_latex"), F.col("query"), has_history, markers)
        )
        .withColumn("student_mood", mood(asked, markers))
        .withColumn("target_focus", focus(F.col("category"), asked, markers))
    )


def repair_labels(labelled: DataFrame, external: DataFrame, key: list[str]) -> DataFrame:
    """Labels from elsewhere (ext_category, ext_mood, ext_focus), made possible for their context.

    Without a task only C1 and C5 can be; the focus of C1 and C3 is fixed; a stray PERSONA is
    replaced. ``repaired`` tells whether anything changed.
    """
    rows = labelled.join(external, key)
    fallback = F.when(F.col("category").isin(*TASKLESS), F.col("category")).otherwise("C1")
    possible = F.col("has_task_context") | F.col("ext_category").isin(*TASKLESS)
    fixed = F.when(possible, F.col("ext_category")).otherwise(fallback)
    goal = (
        F.when(fixed == "C1", "PERSONA")
        .when(fixed == "C3", "EXAM_VALIDITY")
        .when(F.col("ext_focus") == "PERSONA", focus(fixed, F.lit("")))
        .otherwise(F.col("ext_focus"))
    )
    return rows.select(
        *key,
        fixed.alias("category"),
        F.col("ext_mood").alias("student_mood"),
        goal.alias("target_focus"),
        ((fixed != F.col("ext_category")) | (goal != F.col("ext_focus"))).alias("repaired"),
    )


# Ways of naming the right option.
LEAK_FORMS = [
    r"(?:chọn|đáp án|phương án|kết quả)(?:\s+đúng|\s+chính xác)?\s+(?:là\s+)?{letter}\b",
    r"(?:chọn|đáp án)\s+phương án\s+{letter}\b",
    r"\bchọn\s+đáp án\s+{letter}\b",
]
OPTION_LETTERS = "ABCDEF"


def leaks_answer(reply: Column, correct: Column) -> Column:
    """Whether a reply names the right option outright. Only options A to F can be named."""
    letter, text = F.upper(strip(F.coalesce(correct, F.lit("")))), F.lower(reply)
    out = None
    for option in OPTION_LETTERS:
        form = "|".join(f.format(letter=option.lower()) for f in LEAK_FORMS)
        hit = text.rlike(f"(?U)(?:{form})")
        out = F.when(letter == option, hit) if out is None else out.when(letter == option, hit)
    return F.coalesce(out.otherwise(False), F.lit(False))


def leak_rates(replies: DataFrame, key: str) -> DataFrame:
    leaked = F.count_if(leaks_answer(F.col("reply"), F.col("correct_option")))
    return replies.groupBy(key).agg(
        F.count(F.lit(1)).alias("replies"),
        leaked.alias("leaks"),
        F.round(leaked / F.count(F.lit(1)), 4).alias("leak_rate"),
    )


# Criteria by category, and for knowledge categories without grounding.
CRITERIA = {
    "C1": ["friendly_and_pedagogical", "redirect_to_learning"],
    "C2": ["consistent_with_ground_truth", "grounded_in_theorems"],
    "C3": ["consistent_with_ground_truth", "grounded_in_theorems"],
    "C4": ["consistent_with_ground_truth", "grounded_in_theorems"],
    "C5": ["logically_sound_hint"],
}
UNGROUNDED = ["consistent_with_ground_truth", "logically_sound_hint"]


def required_criteria(category_: Column, grounded: Column) -> Column:
    def listed(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    code = F.upper(F.coalesce(F.when(category_ != "", category_), F.lit("C4")))
    out = F.when(code.isin("C2", "C3", "C4") & ~grounded, listed(UNGROUNDED))
    for name, criteria in CRITERIA.items():
        out = out.when(code == name, listed(criteria))
    return out.otherwise(listed(CRITERIA["C4"]))


def passes(revealed: Column, verdicts: Column, criteria: Column) -> Column:
    """No leak, and no required criterion judged false (``verdicts``: map of booleans)."""
    return ~revealed & F.forall(
        criteria, lambda c: F.coalesce(F.try_element_at(verdicts, c), F.lit(True))
    )


def _greets(text: Column, markers: Markers) -> Column:
    opening = "|".join(re.escape(g) for g in markers.greetings)
    return (
        text.isin(*markers.greetings)
        | contains_any(text, list(markers.meta))
        | ((F.length(text) <= GREETING_CHARS) & text.rlike(f"^(?:{opening})(?: |$)"))
    )


def is_greeting(
    query: Column, question: Column, options: Column, markers: Markers = DEFAULT_MARKERS
) -> Column:
    """Greeting or question about the tutor, in the query or in the stem."""

    def clean(text: Column) -> Column:
        return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"[!.,?~^:;]+$", "")

    asked, stem = clean(query), clean(question)
    real_options = (F.size(options) >= MIN_OPTIONS) & F.exists(
        F.map_values(options), lambda v: F.length(v) > LONG_OPTION
    )
    no_history = F.lit(False)
    return (
        F.when((F.coalesce(query, F.lit("")) != "") & _greets(asked, markers), True)
        .when(stem == "", False)
        .when(F.coalesce(real_options, F.lit(False)), False)
        .when(_greets(stem, markers), True)
        .otherwise(category(question, query, no_history, markers) == "C1")
    )


def sessions(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn")
    )


def clear_sessions(turns: DataFrame, requests: DataFrame) -> DataFrame:
    return turns.join(requests.select("conv_id"), "conv_id", "left_anti")


def render(template: Column, variables: Column) -> Column:
    """Replace {{name}} by its value for each entry of a map; null values as nothing."""
    return F.when(variables.isNull(), template).otherwise(
        F.aggregate(
            F.map_entries(variables),
            template,
            lambda text, v: F.replace(
                text,
                F.concat(F.lit("{{"), v["key"], F.lit("}}")),
                F.coalesce(v["value"], F.lit("")),
            ),
        )
    )
