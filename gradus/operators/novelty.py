"""Questions whose archetype the graph does not know yet: detection, staging and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import collapse, is_blank, stable_id, strip
from gradus.operators.retrieval import vector_top_k
from gradus.session import stacked

# The threshold and the names of states.
THRESHOLD = 0.75
NOVEL, MATCHED = "NOVEL_PATTERN_CANDIDATE", "MATCHED_EXISTING"
PENDING = "PENDING_REVIEW"
METADATA = [
    "question_number", "page_number", "suggested_skill_name", "correct_option",
    "difficulty_level", "options", "passage_range",
]


def question_text(content: Column, options: Column) -> Column:
    """Stem and non-blank options by key, on one line. ``options`` is a map of strings."""
    filled = F.filter(F.map_entries(options), lambda e: ~is_blank(e["value"]))
    lines = F.transform(
        F.array_sort(filled), lambda e: F.concat(e["key"], F.lit(". "), strip(e["value"]))
    )
    parts = F.concat(F.array(strip(content)), F.coalesce(lines, F.array().cast("array<string>")))
    return strip(collapse(F.array_join(parts, "\n")))


def with_text(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with the text that is embedded, and those rejected for an empty stem."""
    blank = is_blank(F.col("content"))
    good = questions.where(~blank).withColumn(
        "question_text", question_text(F.col("content"), F.col("options"))
    )
    return good, questions.where(blank).withColumn("reason", F.lit("EMPTY_CONTENT"))


def flatten_exams(exams: DataFrame) -> DataFrame:
    """Nested exams (single_questions; passages with questions) to one row per question.

    Order within an exam is ``(question_number, position)``. Questions without content are dropped.
    """
    singles = exams.select(
        "exam_id", F.posexplode("single_questions").alias("position", "q")
    ).select("exam_id", "position", "q.*", F.lit(None).cast("string").alias("passage_range"))
    grouped = exams.select("exam_id", F.posexplode("passages").alias("_p", "passage")).select(
        "exam_id",
        "_p",
        F.concat_ws("-", "passage.start_question", "passage.end_question").alias("passage_range"),
        F.posexplode("passage.questions").alias("_q", "q"),
    )
    inside = grouped.select(
        "exam_id",
        ((F.col("_p") + 1) * 1_000_000 + F.col("_q")).alias("position"),
        "q.*",
        "passage_range",
    )
    return stacked(singles, inside).where(~is_blank(F.col("content")))


def detect(
    questions: DataFrame, archetypes: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """Nearest archetype, verified or not, and status. No archetype at all counts as similarity 0."""
    nearest = vector_top_k(questions, archetypes, "question_id", "archetype_id", k=1).drop("rank")
    similarity = F.coalesce("similarity", F.lit(0.0))
    rows = questions.join(
        nearest.withColumnRenamed("archetype_id", "nearest_archetype_id"), "question_id", "left"
    )
    return rows.withColumn("max_similarity", similarity).drop("similarity").withColumn(
        "status", F.when(F.col("max_similarity") < threshold, NOVEL).otherwise(MATCHED)
    )


def stage(detected: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals for novel questions, one per text.

    ``detected`` adds source_exam, question_text, image_url, created_at and the metadata columns it
    has. A text that is pending already keeps its proposal, and so does one met earlier in the
    batch (order: question_id). Returns the questions with proposal_id and duplicate_proposal, and
    the rows to append to ``proposals``.
    """
    novel = detected.where(F.col("status") == NOVEL)
    pending = (
        proposals.where(F.col("status") == PENDING)
        .groupBy("raw_question_latex")
        .agg(F.min("id").alias("_existing"))
        .withColumnRenamed("raw_question_latex", "question_text")
    )
    owners = novel.groupBy("question_text").agg(F.min("question_id").alias("_owner"))
    ids = owners.join(pending, "question_text", "left").select(
        "question_text",
        "_owner",
        "_existing",
        F.coalesce("_existing", stable_id(F.lit("proposal"), F.col("question_text"))).alias(
            "proposal_id"
        ),
    )
    staged = novel.join(ids, "question_text").withColumn(
        "duplicate_proposal",
        F.col("_existing").isNotNull() | (F.col("question_id") != F.col("_owner")),
    )
    metadata = F.to_json(F.struct(*[F.col(c) for c in METADATA if c in detected.columns]))
    images = F.when(F.col("image_url") != "", F.array("image_url")).otherwise(
        F.array().cast("array<string>")
    )
    fresh = staged.where("not duplicate_proposal").select(
        F.col("proposal_id").alias("id"),
        F.col("source_exam").alias("source_exam_name"),
        F.col("question_text").alias("raw_question_latex"),
        F.coalesce(images, F.array().cast("array<string>")).alias("image_urls"),
        metadata.alias("extracted_metadata"),
        F.col("max_similarity").alias("max_similarity_score"),
        "nearest_archetype_id",
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("academic_feedback"),
        "created_at",
    )
    return staged.drop("_owner", "_existing"), fresh


def summary(detected: DataFrame, staged: DataFrame) -> DataFrame:
    """Totals per source exam."""
    totals = detected.groupBy("source_exam").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == MATCHED).alias("matched_existing"),
        F.count_if(F.col("status") == NOVEL).alias("novel_candidates"),
    )
    new = staged.groupBy("source_exam").agg(
        F.count_if(~F.col("duplicate_proposal")).alias("new_proposals")
    )
    return totals.join(new, "source_exam", "left").withColumn(
        "new_proposals", F.coalesce("new_proposals", F.lit(0).cast("bigint"))
    )


def proposal_queue(
    proposals: DataFrame,
    archetypes: DataFrame,
    status: str = PENDING,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of proposals, least similar first, with the nearest archetype's names."""
    names = archetypes.select(
        F.col("archetype_id").alias("nearest_archetype_id"),
        F.col("pattern_code").alias("nearest_pattern_code"),
        F.col("pattern_name").alias("nearest_pattern_name"),
    )
    page = (
        proposals.where(F.col("status") == status)
        .orderBy(
            F.col("max_similarity_score").asc_nulls_first(), F.col("created_at").desc(), F.col("id")
        )
        .offset(offset)
        .limit(limit)
    )
    return page.join(names, "nearest_archetype_id", "left")


def proposal_total(proposals: DataFrame, status: str = PENDING) -> DataFrame:
    return proposals.where(F.col("status") == status).agg(F.count(F.lit(1)).alias("total"))


def review(
    proposals: DataFrame, decisions: DataFrame, archetypes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply decisions (decision_no, proposal_id, decision, academic_feedback,
    merged_into_archetype_id). The first valid decision on a pending proposal counts; all others
    come back with a reason.
    """
    known = archetypes.select(
        F.col("archetype_id").alias("merged_into_archetype_id"), F.lit(True).alias("_known")
    )
    pending = proposals.where(F.col("status") == PENDING).select(
        F.col("id").alias("proposal_id"), F.lit(True).alias("_pending")
    )
    target = F.col("merged_into_archetype_id")
    judged = (
        decisions.join(known, "merged_into_archetype_id", "left")
        .join(pending, "proposal_id", "left")
        .withColumn(
            "_reason",
            F.when((F.col("decision") == "MERGED") & target.isNull(), "MISSING_TARGET")
            .when(target.isNotNull() & F.col("_known").isNull(), "UNKNOWN_TARGET")
            .when(F.col("_pending").isNull(), "NOT_PENDING"),
        )
    )
    first = (
        judged.where("_reason is null")
        .groupBy("proposal_id")
        .agg(
            F.min_by(
                F.struct(
                    "decision_no", "decision", "academic_feedback", "merged_into_archetype_id"
                ),
                "decision_no",
            ).alias("_d")
        )
    )
    rows = proposals.join(first.withColumnRenamed("proposal_id", "id"), "id", "left")
    applied = F.col("_d").isNotNull()
    updated = rows.withColumns(
        {
            "status": F.when(applied, F.col("_d.decision")).otherwise(F.col("status")),
            "academic_feedback": F.when(applied, F.col("_d.academic_feedback")).otherwise(
                F.col("academic_feedback")
            ),
            "nearest_archetype_id": F.coalesce(
                "_d.merged_into_archetype_id", "nearest_archetype_id"
            ),
        }
    ).select(*proposals.columns)
    rejects = (
        judged.join(first, "proposal_id", "left")
        .withColumn(
            "reason",
            F.coalesce(
                "_reason", F.when(F.col("_d.decision_no") != F.col("decision_no"), "NOT_PENDING")
            ),
        )
        .where("reason is not null")
        .select(*decisions.columns, "reason")
    )
    return updated, rejects


def upsert_archetypes(
    archetypes: DataFrame, seeds: DataFrame, skills: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Insert or update by pattern_code; the skill is given by name, whatever its case.

    ``archetypes``: archetype_id, skill_id, pattern_code, pattern_name, description, core_theorems,
    fast_solving_heuristics, is_verified. ``seeds``: seed_no, skill_name and the same without ids;
    the last seed of a code counts. New archetypes are verified, updated ones stay as they were.
    Seeds of unknown skills come back as rejects. ``embedding_text`` is to be embedded again.
    """
    body = ["skill_id", "pattern_name", "description", "core_theorems", "fast_solving_heuristics"]
    by_name = skills.groupBy(F.lower("skill_name").alias("_skill")).agg(
        F.min("skill_id").alias("skill_id")
    )
    named = seeds.withColumn("_skill", F.lower("skill_name")).join(by_name, "_skill", "left")
    rejects = named.where("skill_id is null").select(
        *seeds.columns, F.lit("UNKNOWN_SKILL").alias("reason")
    )
    new = (
        named.where("skill_id is not null")
        .groupBy("pattern_code")
        .agg(F.max_by(F.struct(*body), "seed_no").alias("_new"))
    )
    old = archetypes.select(
        "pattern_code", "archetype_id", "is_verified", F.struct(*body).alias("_old")
    )
    value = F.coalesce("_new", "_old")
    merged = old.join(new, "pattern_code", "full_outer").select(
        F.coalesce("archetype_id", stable_id(F.lit("archetype"), F.col("pattern_code"))).alias(
            "archetype_id"
        ),
        "pattern_code",
        *[value[c].alias(c) for c in body],
        F.coalesce("is_verified", F.lit(True)).alias("is_verified"),
        F.when(
            F.col("_new").isNotNull(),
            F.concat_ws("\n", "_new.pattern_name", "_new.description", "_new.core_theorems"),
        ).alias("embedding_text"),
    )
    return merged, rejects


def replace_children(children: DataFrame, replaced: DataFrame, fresh: DataFrame) -> DataFrame:
    """Exemplars or traps after an upsert: those of the seeded archetypes are exchanged."""
    kept = children.join(replaced.select("archetype_id"), "archetype_id", "left_anti")
    return stacked(kept, fresh)
