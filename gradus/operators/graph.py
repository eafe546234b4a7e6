"""Knowledge-graph retrieval for whole question tables.

``archetypes``: archetype_id, skill_id, pattern_code, pattern_name, core_theorems,
fast_solving_heuristics, is_verified, embedding.
``exemplars``: archetype_id, exemplar_id, question_latex, golden_solution, correct_option,
explanation_steps, created_at.  ``traps``: archetype_id, trap_id, trap_code, trap_name,
wrong_option, misconception_explanation, socratic_hint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import is_blank, is_uuid, strip
from gradus.operators.retrieval import vector_top_k
from gradus.operators.substrings import small
from gradus.session import checkpointed, stacked

# Similarity floor, numbers kept, identity ratio, the mark of curriculum material.
MIN_SIMILARITY = 0.75
TOP_K = 3
MAX_EXEMPLARS = 2
IDENTITY_RATIO = 0.90
MATERIAL_SIMILARITY = 0.98
EXPLANATION_TITLE = "Phương pháp giải bài tập khảo thí"
MATERIAL_TITLE = "Tài liệu học tập ĐGNL"

#: Questions and traps that meet in one block, blocks of a task, most tasks, and archetypes to broadcast.
BLOCK_SIDE, BLOCKS_PER_TASK, MAX_TASKS, BROADCAST_CUTS = 1000, 4, 20_000, 100_000


def grounding(similarity: Column, min_similarity: float = MIN_SIMILARITY) -> Column:
    return (
        F.when(similarity.isNull(), "NOT_FOUND")
        .when(similarity >= min_similarity, "GROUNDED")
        .otherwise("LOW_CONFIDENCE")
    )


def anchors(
    questions: DataFrame,
    archetypes: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    top_k: int = TOP_K,
) -> DataFrame:
    """Nearest verified archetypes per question: rows (question_id, scope, rank, archetype_id,
    similarity).

    The question's own skill is tried first. All archetypes stand in if that gives nothing, or if
    its best stays below the floor and the best of all is strictly nearer.
    """
    bank = archetypes.where("is_verified and embedding is not null").select(
        "archetype_id", F.col("skill_id").alias("_skill"), "embedding"
    )
    every = vector_top_k(questions, bank, "question_id", "archetype_id", top_k)
    own = vector_top_k(
        questions.where("skill_id is not null"), bank, "question_id", "archetype_id", top_k,
        query_scope="skill_id", bank_scope="_skill",
    )
    both = checkpointed(
        stacked(own.withColumn("scope", F.lit("SKILL")), every.withColumn("scope", F.lit("GLOBAL")))
    )
    best = both.groupBy("question_id").agg(
        F.max(F.when(F.col("scope") == "SKILL", F.col("similarity"))).alias("_own"),
        F.max(F.when(F.col("scope") == "GLOBAL", F.col("similarity"))).alias("_all"),
    )
    use_all = F.col("_own").isNull() | (
        (F.col("_own") < min_similarity) & (F.col("_all") > F.col("_own"))
    )
    chosen = best.select("question_id", F.when(use_all, "GLOBAL").otherwise("SKILL").alias("scope"))
    return both.join(chosen, ["question_id", "scope"]).select(
        "question_id", "scope", "rank", "archetype_id", "similarity"
    )


def ground(
    questions: DataFrame, anchor_rows: DataFrame, min_similarity: float = MIN_SIMILARITY
) -> DataFrame:
    """One row per question with status; only a grounded question keeps its anchor."""
    best = anchor_rows.where("rank = 1").drop("rank")
    kept = F.col("similarity") >= min_similarity
    found = questions.select("question_id").join(best, "question_id", "left")
    return found.select(
        "question_id",
        F.when(kept, "GROUNDED").otherwise("LOW_CONFIDENCE").alias("status"),
        *[F.when(kept, F.col(c)).alias(c) for c in ("scope", "archetype_id", "similarity")],
    )


def match_form(text: Column) -> Column:
    """Loose form for comparing questions: no LaTeX delimiters, lower case, single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[$\\{}]", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def word_overlap(a: Column, b: Column) -> Column:
    """Distinct words that both texts have, over all that either has, to four places; 1 without words."""
    x, y = (F.array_remove(F.array_distinct(F.split(t, " ")), "") for t in (a, b))
    shared = F.size(F.array_intersect(x, y))
    return F.round(F.coalesce(F.try_divide(shared, F.size(x) + F.size(y) - shared), F.lit(1.0)), 4)


def nearest_exemplars(
    questions: DataFrame, exemplars: DataFrame, keep: int = MAX_EXEMPLARS
) -> DataFrame:
    """The anchor's exemplars with texts most like the question's by ``word_overlap``, best first.

    ``questions``: question_id, archetype_id, text. Questions meet the exemplars of their own
    archetype only; hot archetypes are split as skewed join keys, and the rank filter lets map tasks
    drop all but the best few of a question before the shuffle. Ties go to the older exemplar.
    """
    q = questions.where("archetype_id is not null").select(
        "question_id", "archetype_id", match_form(F.col("text")).alias("_q")
    )
    e = exemplars.select(
        "exemplar_id", "archetype_id", "created_at", match_form(F.col("question_latex")).alias("_e")
    )
    pairs = q.join(e, "archetype_id").select(
        "question_id", "exemplar_id", "created_at",
        word_overlap(F.col("_q"), F.col("_e")).alias("text_match_ratio"),
    )
    order = Window.partitionBy("question_id").orderBy(
        F.col("text_match_ratio").desc(), "created_at", "exemplar_id"
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.drop("created_at")


def _letter(option: Column) -> Column:
    return F.upper(strip(F.coalesce(option, F.lit(""))))


def resolve_traps(asks: DataFrame, traps: DataFrame) -> DataFrame:
    """Which misconception a wrong choice points to, per question.

    ``asks``: question_id, archetype_id, selected_option, correct_option, is_exemplar. A known
    exemplar with a trap for the chosen letter gives that trap; otherwise all traps of the archetype
    are candidates (``candidate_count``; their rows come from ``candidate_traps``).
    """
    counts = traps.groupBy("archetype_id").agg(F.count(F.lit(1)).alias("_traps"))
    by_letter = (
        traps.withColumn("_letter", _letter(F.col("wrong_option")))
        .where("_letter <> ''")
        .groupBy("archetype_id", "_letter")
        .agg(F.min(F.struct("wrong_option", "trap_code", "trap_id")).alias("_trap"))
    )
    rows = (
        asks.withColumn("_letter", _letter(F.col("selected_option")))
        .join(counts, "archetype_id", "left")
        .join(by_letter, ["archetype_id", "_letter"], "left")
    )
    right = (F.col("_letter") != "") & (
        F.coalesce(F.col("correct_option"), F.lit("")) != ""
    ) & (F.col("_letter") == _letter(F.col("correct_option")))
    none = F.col("_traps").isNull() | right
    matched = F.coalesce("is_exemplar", F.lit(False)) & F.col("_trap").isNotNull()
    return rows.select(
        *asks.columns,
        F.when(none, "NONE")
        .when(matched, "EXEMPLAR_OPTION_LETTER")
        .otherwise("ARCHETYPE_CANDIDATES")
        .alias("strategy"),
        F.when(~none & matched, F.col("_trap.trap_id")).alias("matched_trap_id"),
        F.when(none | matched, 0).otherwise(F.col("_traps")).cast("bigint").alias("candidate_count"),
    )


def candidate_traps(resolved: DataFrame, traps: DataFrame, side: int = BLOCK_SIDE) -> DataFrame:
    """A row per question and trap of its archetype, where no single trap was matched.

    An archetype's questions and traps are both cut into parts of about ``side``, and any two parts
    meet in one block. The blocks are dealt over as many partitions as their number asks for, so a
    task makes about ``BLOCKS_PER_TASK * side * side`` rows however many there are of an archetype.
    """
    asked = resolved.where("strategy = 'ARCHETYPE_CANDIDATES'").select("question_id", "archetype_id")

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("archetype_id").agg(F.ceil(F.count(F.lit(1)) / side).alias(name))

    cuts = checkpointed(parts(asked, "_asks").join(parts(traps, "_traps"), "archetype_id"))
    blocks = cuts.agg(F.sum(F.col("_asks") * F.col("_traps"))).first()[0] or 0
    tasks = min(MAX_TASKS, max(1, math.ceil(blocks / BLOCKS_PER_TASK)))
    cuts, block = small(cuts, BROADCAST_CUTS), ["archetype_id", "_a", "_t"]

    def met(rows: DataFrame, key: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        (place, count), (each, times) = own, other
        dealt = rows.join(cuts, "archetype_id").withColumn(place, F.pmod(F.xxhash64(key), F.col(count)))
        spread = dealt.withColumn(each, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1)))
        return spread.select(*rows.columns, place, each).repartition(tasks, *block)

    a, t = ("_a", "_asks"), ("_t", "_traps")
    return met(asked, "question_id", a, t).join(met(traps, "trap_id", t, a), block).drop("_a", "_t")


def materials_for(asks: DataFrame, questions: DataFrame, materials: DataFrame) -> DataFrame:
    """Official material per asked question, by priority; rows without any are left out.

    1 the lesson of the question's skill, 2 the question's own explanation, 3 the lesson of the
    skill given with the ask. Malformed ids skip their step. One lesson per skill: lowest id.
    """
    lessons = (
        materials.groupBy("skill_id")
        .agg(F.min(F.struct("material_id", "title", "content")).alias("_lesson"))
        .select("skill_id", "_lesson.*")
    )
    known = questions.select(
        F.col("question_id"), F.col("skill_id").alias("_q_skill"), "explanation"
    ).join(
        lessons.select(
            F.col("skill_id").alias("_q_skill"),
            F.struct("material_id", "title", "content").alias("_by_question"),
        ),
        "_q_skill",
        "left",
    )
    asked_skill = lessons.select(
        F.col("skill_id").alias("_ask_skill"),
        F.struct("material_id", "title", "content").alias("_by_skill"),
    )
    rows = (
        asks.withColumn("_ask_skill", F.when(is_uuid(F.col("skill_id")), F.col("skill_id")))
        .withColumn("_q_id", F.when(is_uuid(F.col("question_id")), F.col("question_id")))
        .join(known.withColumnRenamed("question_id", "_q_id"), "_q_id", "left")
        .join(asked_skill, "_ask_skill", "left")
    )
    own = F.when(
        F.length(F.trim("explanation")) > 0,
        F.struct(
            F.col("_q_id").alias("material_id"),
            F.lit(EXPLANATION_TITLE).alias("title"),
            F.col("explanation").alias("content"),
        ),
    )

    def usable(lesson: str) -> Column:
        return F.when(F.coalesce(F.col(f"{lesson}.content"), F.lit("")) != "", F.col(lesson))

    first, third = usable("_by_question"), usable("_by_skill")
    picked = rows.withColumn("_pick", F.coalesce(first, own, third)).where("_pick is not null")
    from_question = F.coalesce(first, own).isNotNull()
    return picked.select(
        "question_id",
        F.col("_pick.material_id").alias("material_id"),
        F.col("_pick.title").alias("title"),
        F.col("_pick.content").alias("content"),
        F.when(from_question, F.col("explanation")).alias("explanation"),
        F.when(from_question, F.col("_q_skill"))
        .otherwise(F.col("_ask_skill"))
        .alias("material_skill_id"),
        F.when(first.isNotNull(), 1).when(own.isNotNull(), 2).otherwise(3).alias("priority"),
    )


def subgraphs(
    asks: DataFrame,
    archetypes: DataFrame,
    exemplars: DataFrame,
    traps: DataFrame,
    content_questions: DataFrame,
    materials: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """One row per ask with its grounded surroundings.

    ``asks``: question_id, skill_id, text, selected_option, correct_option, embedding. Curriculum
    material wins; other questions go through the nearest archetype, or stay ungrounded.
    """
    material = materials_for(asks, content_questions, materials)
    of_skill = archetypes.groupBy("skill_id").agg(F.min("archetype_id").alias("archetype_id"))
    taught = (
        asks.drop("embedding")
        .join(material, "question_id")
        .join(of_skill.withColumnRenamed("skill_id", "material_skill_id"), "material_skill_id", "left")
        .select(
            "question_id", "text", "selected_option", "correct_option", "archetype_id",
            F.lit("GROUNDED").alias("status"),
            F.lit("CURRICULUM_MATERIAL").alias("scope"),
            F.lit(MATERIAL_SIMILARITY).alias("similarity"),
            F.concat(F.lit("CURRICULUM_"), F.substring("material_id", 1, 8)).alias("pattern_code"),
            F.coalesce("title", F.lit(MATERIAL_TITLE)).alias("pattern_name"),
            F.col("content").alias("core_theorems"),
            F.lit(None).cast("string").alias("fast_solving_heuristics"),
            (F.coalesce("explanation", F.lit("")) != "").alias("is_exemplar"),
        )
    )
    others = asks.join(material.select("question_id"), "question_id", "left_anti")
    grounded = checkpointed(
        ground(others, anchors(others, archetypes, min_similarity), min_similarity)
    )
    names = archetypes.select(
        "archetype_id", "pattern_code", "pattern_name", "core_theorems", "fast_solving_heuristics"
    )
    placed = others.drop("embedding").join(grounded, "question_id")
    close = nearest_exemplars(placed, exemplars)
    is_exemplar = close.groupBy("question_id").agg(
        (F.max("text_match_ratio") >= IDENTITY_RATIO).alias("is_exemplar")
    )
    found = (
        placed.join(names, "archetype_id", "left")
        .join(is_exemplar, "question_id", "left")
        .select(*taught.columns)
    )
    return resolve_traps(stacked(taught, found), traps)


# What the tutor is given where the graph has nothing.
DEFAULT_PATTERN = "Dạng bài chuẩn ĐGNL"
DEFAULT_THEOREMS = "Vận dụng định lý và tính chất cơ bản."
CANDIDATES_NAME = "Các bẫy tư duy thường gặp trong dạng bài này"
CANDIDATES_HINT = "Em hãy xem lại điều kiện ràng buộc của bài toán."
NO_TRAP_NAME = "Lỗi nhận thức phổ biến"
NO_TRAP_TEXT = "Có thể em đang nhầm lẫn ở bước chuyển đổi đại lượng hoặc điều kiện biên."
NO_TRAP_HINT = "Em hãy kiểm tra lại định nghĩa của các đại lượng trong đề bài nhé."


def tutor_payload(resolved: DataFrame, traps: DataFrame) -> DataFrame:
    """Texts handed to the tutor. The bullet list is made once per archetype, not per question."""
    bullet = F.concat(
        F.lit("- "),
        "trap_name",
        F.when(
            F.coalesce("wrong_option", F.lit("")) != "",
            F.concat(F.lit(" (phương án "), "wrong_option", F.lit(")")),
        ).otherwise(""),
        F.lit(": "),
        "misconception_explanation",
    )
    lists = (
        traps.withColumn("_bullet", bullet)
        .groupBy("archetype_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("wrong_option").isNull().alias("last"),
                        "wrong_option", "trap_code", "_bullet", "socratic_hint",
                    )
                )
            ).alias("_all")
        )
        .select(
            "archetype_id",
            F.array_join(F.transform("_all", lambda t: t["_bullet"]), "\n").alias("_bullets"),
            F.col("_all")[0]["socratic_hint"].alias("_first_hint"),
        )
    )
    single = traps.select(
        F.col("trap_id").alias("matched_trap_id"),
        F.col("trap_name").alias("_name"),
        F.col("misconception_explanation").alias("_text"),
        F.col("socratic_hint").alias("_hint"),
    )
    rows = resolved.join(single, "matched_trap_id", "left").join(lists, "archetype_id", "left")
    matched = F.col("strategy") == "EXEMPLAR_OPTION_LETTER"
    several = F.col("strategy") == "ARCHETYPE_CANDIDATES"
    grounded = F.col("status") == "GROUNDED"

    def known(name: str, default: str) -> Column:
        value = F.when(grounded & (F.col(name) != ""), F.col(name))
        return F.coalesce(value, F.lit(default)).alias(name)

    return rows.select(
        "question_id",
        known("pattern_name", DEFAULT_PATTERN),
        known("core_theorems", DEFAULT_THEOREMS),
        known("fast_solving_heuristics", ""),
        F.when(matched, F.col("_name")).when(several, CANDIDATES_NAME).otherwise(NO_TRAP_NAME)
        .alias("trap_name"),
        F.when(matched, F.col("_text")).when(several, F.col("_bullets")).otherwise(NO_TRAP_TEXT)
        .alias("misconception"),
        F.when(matched, F.col("_hint"))
        .when(several, F.coalesce("_first_hint", F.lit(CANDIDATES_HINT)))
        .otherwise(NO_TRAP_HINT)
        .alias("socratic_hint"),
    )


def blank_asks(asks: DataFrame) -> DataFrame:
    return asks.where(is_blank(F.col("text")))
