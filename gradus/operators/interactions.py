"""The log of tutoring interactions and what students and mentors do with it.

``log``: id, student_id, question_id, archetype_id, student_selected_option, correct_option,
matched_trap_id, transcript (JSON), validation_status, student_reported, mentor_resolution,
created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import stable_id, strip
from gradus.session import stacked

# Notes and defaults.
REPORTED = "REPORTED_BY_STUDENT"
EXEMPLAR_SAVED, TRAP_ADDED = "OVERRIDDEN_EXEMPLAR_SAVED", "NEW_TRAP_ADDED"
DEFAULT_CORRECT, DEFAULT_WRONG = "A", "B"
TRANSCRIPT = "array<struct<role:string,text:string>>"


def log_rows(turns: DataFrame) -> DataFrame:
    """Interactions as appended: the transcript (array of role and text) becomes JSON."""
    return turns.withColumn("transcript", F.to_json("transcript"))


def audit_list(
    log: DataFrame,
    archetypes: DataFrame,
    traps: DataFrame,
    reported_only: bool = False,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Interactions, newest first, with names of pattern and trap. Broken transcripts are empty."""
    rows = log.where("student_reported") if reported_only else log
    if limit is not None:
        rows = rows.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
    names = archetypes.select("archetype_id", "pattern_code", "pattern_name", "core_theorems")
    causes = traps.select(
        F.col("trap_id").alias("matched_trap_id"), "trap_code", "trap_name",
        "misconception_explanation",
    )
    parsed = F.from_json("transcript", TRANSCRIPT, {"mode": "PERMISSIVE"})
    return (
        rows.join(names, "archetype_id", "left")
        .join(causes, "matched_trap_id", "left")
        .withColumns(
            {
                "transcript": F.coalesce(parsed, F.array().cast(TRANSCRIPT)),
                "validation_status": F.coalesce(
                    F.when(F.col("validation_status") != "", F.col("validation_status")),
                    F.lit("PASSED"),
                ),
                "student_reported": F.coalesce("student_reported", F.lit(False)),
                "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            }
        )
        .orderBy(F.col("created_at").desc(), "id")
    )


def apply_reports(log: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reports``: report_no, interaction_id, reason. The first note stays; unknown ids come back."""
    note = F.when(
        F.coalesce("reason", F.lit("")) != "",
        F.concat(F.lit("REPORTED: "), strip(F.col("reason"))),
    ).otherwise(REPORTED)
    first = (
        reports.withColumn("_note", note)
        .groupBy(F.col("interaction_id").alias("id"))
        .agg(F.min_by("_note", "report_no").alias("_note"))
    )
    updated = log.join(first, "id", "left").withColumns(
        {
            "student_reported": F.col("student_reported") | F.col("_note").isNotNull(),
            "mentor_resolution": F.coalesce("mentor_resolution", "_note"),
        }
    )
    unknown = reports.join(
        log.select(F.col("id").alias("interaction_id")), "interaction_id", "left_anti"
    ).withColumn("reason_rejected", F.lit("NOT_FOUND"))
    return updated.select(*log.columns), unknown


def _aimed(log: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentor events with their interaction and target archetype, and those without one."""
    facts = log.select(
        F.col("id").alias("interaction_id"),
        F.col("archetype_id").alias("_logged"),
        "question_id",
        F.col("correct_option").alias("_correct"),
        F.col("student_selected_option").alias("_selected"),
        F.lit(True).alias("_known"),
    )
    rows = events.join(facts, "interaction_id", "left").withColumn(
        "target_archetype_id", F.coalesce("archetype_id", "_logged")
    )
    reason = F.when(F.col("_known").isNull(), "NOT_FOUND").when(
        F.col("target_archetype_id").isNull(), "NO_ARCHETYPE"
    )
    rows = rows.withColumn("reason", reason)
    rejects = rows.where("reason is not null").select(*events.columns, "reason")
    return rows.where("reason is null"), rejects


def _resolved(log: DataFrame, done: DataFrame, note: str) -> DataFrame:
    ids = done.select(F.col("interaction_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    out = log.join(ids, "id", "left").withColumn(
        "mentor_resolution", F.when(F.col("_done"), note).otherwise(F.col("mentor_resolution"))
    )
    return out.select(*log.columns)


def _given(column: str, *others: Column) -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), *others)


def override_exemplars(
    log: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentors' own solutions as exemplars: (exemplars to append, log, rejects).

    ``events``: event_id, interaction_id, archetype_id, question_latex, golden_solution,
    correct_option, explanation_steps, created_at.
    """
    aimed, rejects = _aimed(log, events)
    logged = F.when(F.col("_correct") != "", F.col("_correct"))
    fresh = aimed.select(
        F.col("target_archetype_id").alias("archetype_id"),
        stable_id(F.lit("exemplar"), F.col("event_id")).alias("exemplar_id"),
        _given("question_latex", F.concat(F.lit("Question "), "question_id")).alias("question_latex"),
        "golden_solution",
        _given("correct_option", logged, F.lit(DEFAULT_CORRECT)).alias("correct_option"),
        "explanation_steps",
        "created_at",
    )
    return fresh, _resolved(log, aimed, EXEMPLAR_SAVED), rejects


def add_traps(log: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Misconceptions mentors found: (traps to append, log, rejects).

    ``events``: event_id, interaction_id, archetype_id, trap_code, trap_name, wrong_option,
    misconception_explanation, socratic_hint. A missing code is made from the event, so that a
    rerun makes the same one.
    """
    aimed, rejects = _aimed(log, events)
    code = F.concat(
        F.lit("TRAP_MENTOR_"),
        F.upper(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8)),
    )
    selected = F.when(F.col("_selected") != "", F.col("_selected"))
    fresh = aimed.select(
        F.col("target_archetype_id").alias("archetype_id"),
        stable_id(F.lit("trap"), F.col("event_id")).alias("trap_id"),
        _given("trap_code", code).alias("trap_code"),
        "trap_name",
        _given("wrong_option", selected, F.lit(DEFAULT_WRONG)).alias("wrong_option"),
        "misconception_explanation",
        "socratic_hint",
    )
    return fresh, _resolved(log, aimed, TRAP_ADDED), rejects


def appended(table: DataFrame, fresh: DataFrame) -> DataFrame:
    return stacked(table, fresh.select(*table.columns))
