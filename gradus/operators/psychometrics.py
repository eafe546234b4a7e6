"""Ability, mastery and placement over a table of answers.

``responses``: student_id, submission_id, answer_no (order of answering, unique in a submission),
question_id, skill_id, domain_id, difficulty_level, is_correct, time_spent_seconds. Each skill
belongs to one domain (``skills_in_many_domains`` audits that).

Answers are shuffled once, already reduced to counts per (submission, domain, skill); domain and
submission figures are sums of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import irt
from gradus.operators.blocks import attach_dimension
from gradus.session import checkpointed, stacked

SUBMISSION = ["student_id", "submission_id"]
DEFAULT_MODEL = irt.ItemModel()
MIN_ITEMS_DOMAIN = 3
MIN_ITEMS_SKILL = 2
SINGLE_ITEM_SHIFT = 0.3
WEAK_BELOW_PCT = 60.0
DEFAULT_TARGET = 800


def item_parameters(responses: DataFrame, model: irt.ItemModel = DEFAULT_MODEL) -> DataFrame:
    rapid = irt.is_rapid(F.col("time_spent_seconds"), model)
    return responses.withColumns(
        {
            "b": irt.item_difficulty(F.col("difficulty_level"), model),
            "a": F.when(rapid, F.lit(model.rapid_discrimination)).otherwise(
                F.lit(model.discrimination)
            ),
            "c": F.lit(model.guessing),
        }
    )


def item_cells(
    responses: DataFrame, keys: list[str], model: irt.ItemModel = DEFAULT_MODEL
) -> DataFrame:
    """Sufficient statistics in long form: answers per key, item parameters and outcome."""
    return (
        item_parameters(responses, model)
        .groupBy(*keys, "b", "a", "is_correct")
        .agg(F.count(F.lit(1)).alias("answers"))
    )


def _percent(right: Column, total: Column) -> Column:
    return F.bround(F.lit(100.0) * (right / total), 2)


def answer_counts(
    responses: DataFrame, keys: list[str], model: irt.ItemModel = DEFAULT_MODEL
) -> DataFrame:
    """Sufficient statistics in wide form: a right and a wrong count per item cell."""
    cell = irt.cell_number(F.col("difficulty_level"), F.col("time_spent_seconds"), model)
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    n = len(model.cells)
    return (
        responses.withColumn("_cell", cell + F.when(right, 0).otherwise(n))
        .groupBy(*keys)
        .agg(
            *[
                F.count(F.when(F.col("_cell") == i, 1)).alias(name)
                for i, name in enumerate(model.count_columns)
            ],
            F.count(F.lit(1)).alias("total_questions"),
            F.count(F.when(right, 1)).alias("correct_count"),
            F.min("answer_no").alias("first_seen"),
        )
    )


def roll_up(counts: DataFrame, keys: list[str], model: irt.ItemModel = DEFAULT_MODEL) -> DataFrame:
    return counts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in model.count_columns],
        F.sum("total_questions").alias("total_questions"),
        F.sum("correct_count").alias("correct_count"),
        F.min("first_seen").alias("first_seen"),
    )


def ability(
    counts: DataFrame,
    model: irt.ItemModel = DEFAULT_MODEL,
    method: str = "refined",
    min_items: int = 1,
) -> DataFrame:
    """Adds ``theta``. ``refined`` follows the reference search; ``grid`` is a coarse check on it.

    Keys with fewer than ``min_items`` answers get 0 and are to be given another estimate. Most keys of
    a fine grain are such; they do not go through Python.
    """
    if min_items <= 1:
        return counts.withColumn("theta", irt.theta(model, method))
    answers = sum((F.col(c) for c in model.count_columns), F.lit(0))
    solved = counts.where(answers >= min_items).withColumn("theta", irt.theta(model, method))
    return stacked(solved, counts.where(answers < min_items).withColumn("theta", F.lit(0.0)))


def submission_ability(
    responses: DataFrame, model: irt.ItemModel = DEFAULT_MODEL, method: str = "refined"
) -> DataFrame:
    counts = answer_counts(responses, SUBMISSION, model)
    return ability(counts, model, method).withColumn("placement_class", irt.placement(F.col("theta")))


def placement_counts(abilities: DataFrame, keys: list[str]) -> DataFrame:
    return abilities.groupBy(*keys, "placement_class").agg(F.count(F.lit(1)).alias("students"))


def standard_errors(abilities: DataFrame, model: irt.ItemModel = DEFAULT_MODEL) -> DataFrame:
    """Standard error with the N(0, 2) prior counted as information."""
    prior = F.lit(1.0 / irt.PRIOR_SD**2)
    se = F.lit(1.0) / F.sqrt(irt.information(F.col("theta"), model) + prior)
    return abilities.withColumn("standard_error", F.round(se, 4))


def domain_scores(
    domain_counts: DataFrame,
    abilities: DataFrame,
    domain_names: DataFrame,
    model: irt.ItemModel = DEFAULT_MODEL,
) -> DataFrame:
    """Per domain: own ability from three answers up, the submission's below that."""
    own = ability(domain_counts, model, min_items=MIN_ITEMS_DOMAIN).withColumnRenamed("theta", "_own")
    overall = abilities.select(*SUBMISSION, F.col("theta").alias("_overall"))
    return (
        own.join(overall, SUBMISSION)
        .join(domain_names, "domain_id", "left")
        .select(
            *SUBMISSION,
            "domain_id",
            F.coalesce("domain_name", F.col("domain_id").cast("string")).alias("domain_name"),
            F.when(F.col("total_questions") >= MIN_ITEMS_DOMAIN, F.col("_own"))
            .otherwise(F.col("_overall"))
            .alias("theta_domain"),
            "total_questions",
            "correct_count",
            _percent(F.col("correct_count"), F.col("total_questions")).alias("accuracy_pct"),
            "first_seen",
        )
    )


def measured_priors(
    skill_counts: DataFrame, domains: DataFrame, model: irt.ItemModel = DEFAULT_MODEL
) -> DataFrame:
    """Mastery priors of answered skills."""
    own = ability(skill_counts, model, min_items=MIN_ITEMS_SKILL).withColumnRenamed("theta", "_own")
    parent = domains.select(*SUBMISSION, "domain_id", "theta_domain")
    shift = F.when(F.col("correct_count") > 0, SINGLE_ITEM_SHIFT).otherwise(-SINGLE_ITEM_SHIFT)
    single = F.coalesce(F.col("theta_domain"), F.lit(0.0)) + shift
    return (
        own.join(parent, [*SUBMISSION, "domain_id"], "left")
        .withColumn(
            "_theta",
            F.when(F.col("total_questions") >= MIN_ITEMS_SKILL, F.col("_own")).otherwise(single),
        )
        .select(
            *SUBMISSION,
            "skill_id",
            "domain_id",
            irt.four_digits(F.col("_theta")).alias("theta_skill"),
            F.round(irt.mastery(F.col("_theta")), 4).alias("p_l0"),
            F.lit("measured").alias("source"),
        )
    )


def inferred_priors(skill_counts: DataFrame, domains: DataFrame, skills: DataFrame) -> DataFrame:
    """Mastery priors of catalog skills without an answer, from the domain's ability.

    The result holds every (submission, unanswered skill), as the reference's does. It is made by
    exploding, within the row of a submission, the catalog minus the answered skills.
    """
    answered = skill_counts.groupBy(*SUBMISSION).agg(F.collect_set("skill_id").alias("_answered"))
    thetas = domains.groupBy(*SUBMISSION).agg(
        F.map_from_entries(F.collect_list(F.struct("domain_id", "theta_domain"))).alias("_thetas")
    )
    catalog = skills.select("skill_id", "domain_id").dropDuplicates(["skill_id"])
    rows = attach_dimension(answered.join(thetas, SUBMISSION), catalog, "_catalog")
    missing = F.filter("_catalog", lambda s: ~F.array_contains(F.col("_answered"), s["skill_id"]))
    theta = F.coalesce(F.col("_thetas")[F.col("_skill.domain_id")], F.lit(0.0))
    return rows.withColumn("_skill", F.explode(missing)).select(
        *SUBMISSION,
        F.col("_skill.skill_id").alias("skill_id"),
        F.col("_skill.domain_id").alias("domain_id"),
        irt.four_digits(theta).alias("theta_skill"),
        F.round(irt.mastery(theta), 4).alias("p_l0"),
        F.lit("inferred_from_domain").alias("source"),
    )


def skill_priors(
    skill_counts: DataFrame,
    domains: DataFrame,
    skills: DataFrame,
    model: irt.ItemModel = DEFAULT_MODEL,
) -> DataFrame:
    return stacked(
        measured_priors(skill_counts, domains, model),
        inferred_priors(skill_counts, domains, skills),
    )


def requested_priors(
    requests: DataFrame, measured: DataFrame, domains: DataFrame, skills: DataFrame
) -> DataFrame:
    """The mastery prior of each distinct requested (submission, skill) that the catalog or an answer knows.

    What is stored is one row for each answered (submission, skill) and each (submission, domain), so
    the work grows with the answers and the requests; the catalog is never multiplied by the students.
    Submissions without an answer get the average ability for every skill, as in ``inferred_priors``.
    """
    key = [*SUBMISSION, "skill_id"]
    own = measured.select(
        *key, F.struct("domain_id", "theta_skill", "p_l0").alias("_own")
    )
    catalog = skills.select("skill_id", F.col("domain_id").alias("_domain")).dropDuplicates(["skill_id"])
    known = domains.select(*SUBMISSION, F.col("domain_id").alias("_domain"), "theta_domain")
    theta = F.coalesce("theta_domain", F.lit(0.0))
    return (
        requests.select(*key).distinct()
        .join(own, key, "left")
        .join(catalog, "skill_id", "left")
        .where("_own IS NOT NULL OR _domain IS NOT NULL")
        .join(known, [*SUBMISSION, "_domain"], "left")
        .select(
            *key,
            F.coalesce("_own.domain_id", "_domain").alias("domain_id"),
            F.coalesce("_own.theta_skill", irt.four_digits(theta)).alias("theta_skill"),
            F.coalesce("_own.p_l0", F.round(irt.mastery(theta), 4)).alias("p_l0"),
            F.when(F.col("_own").isNotNull(), "measured").otherwise("inferred_from_domain").alias("source"),
        )
    )


def skills_in_many_domains(responses: DataFrame) -> DataFrame:
    return (
        responses.groupBy("skill_id")
        .agg(F.min("domain_id").alias("lowest_domain"), F.max("domain_id").alias("highest_domain"))
        .where(F.col("lowest_domain") != F.col("highest_domain"))
    )


def domain_accuracy(responses: DataFrame, domain_names: DataFrame) -> DataFrame:
    """The part of ``domain_scores`` that takes no ability: share of right answers per domain."""
    right = F.count(F.when(F.col("is_correct"), 1))
    counts = responses.groupBy(*SUBMISSION, "domain_id").agg(
        F.count(F.lit(1)).alias("total_questions"), right.alias("correct_count")
    )
    return counts.join(domain_names, "domain_id", "left").select(
        *SUBMISSION,
        "domain_id",
        F.coalesce("domain_name", F.col("domain_id").cast("string")).alias("domain_name"),
        _percent(F.col("correct_count"), F.col("total_questions")).alias("accuracy_pct"),
    )


def radar_axes(
    domains: DataFrame, targets: DataFrame, default_target: int = DEFAULT_TARGET
) -> DataFrame:
    """Axis per domain: own accuracy against the share of the full mark the student aims at, or of
    ``default_target`` where none is known."""
    target = F.coalesce("target_score", F.lit(default_target))
    benchmark = F.bround(target / F.lit(irt.EXAM_MAX_SCORE) * 100.0, 2)
    return domains.join(targets.select("student_id", "target_score"), "student_id", "left").select(
        *SUBMISSION,
        "domain_id",
        "domain_name",
        F.col("accuracy_pct").alias("student_pct"),
        benchmark.alias("benchmark_pct"),
    )


def weak_skills(responses: DataFrame, below_pct: float = WEAK_BELOW_PCT) -> DataFrame:
    right = F.count(F.when(F.col("is_correct"), 1))
    return (
        responses.groupBy(*SUBMISSION, "skill_id")
        .agg(F.count(F.lit(1)).alias("total_questions"), right.alias("correct_count"))
        .withColumn("accuracy_pct", _percent(F.col("correct_count"), F.col("total_questions")))
        .where(F.col("accuracy_pct") < below_pct)
    )


# The wording of the remark.
PLACEMENT_LABELS = {
    "FOUNDATION": "Lớp Nền tảng (Foundation) — tập trung củng cố kiến thức trọng tâm",
    "ACCELERATION": "Lớp Tăng tốc (Acceleration) — rèn luyện phương pháp và tư duy nâng cao",
    "BREAKTHROUGH": "Lớp Bứt phá (Breakthrough) — chinh phục các câu hỏi vận dụng cao 900+",
}
REMARK_OPENING = (
    "Kết quả phân tích cho thấy năng lực tổng quan θ = %s. Bạn được đề xuất tham gia %s. "
)
REMARK_ONE_DOMAIN = "Lĩnh vực '%s' đạt độ chính xác %s%%."
REMARK_DOMAINS = (
    "Thế mạnh nổi bật của bạn là '%s' (độ chính xác %s%%). "
    "Cần ưu tiên bổ trợ kiến thức ở lĩnh vực '%s' (%s%%) để đạt mục tiêu điểm thi mong đợi."
)
REMARK_NO_DOMAIN = "Học sinh được phân lớp vào %s (ước lượng năng lực θ = %s)."


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def remarks(abilities: DataFrame, domains: DataFrame) -> DataFrame:
    """Strongest and weakest domain in words; ties go to the domain met first, resp. last."""
    summary = F.struct("domain_id", "domain_name", "accuracy_pct")
    ends = domains.groupBy(*SUBMISSION).agg(
        F.max_by(summary, F.struct("accuracy_pct", -F.col("first_seen"))).alias("_best"),
        F.min_by(summary, F.struct("accuracy_pct", -F.col("first_seen"))).alias("_worst"),
    )
    label = F.col("placement_class")
    for code, text in PLACEMENT_LABELS.items():
        label = F.when(F.col("placement_class") == code, text).otherwise(label)
    # A zero ability has no sign in words.
    unsigned = F.when(F.col("theta") == 0, F.lit(0.0)).otherwise(F.col("theta"))
    theta = F.format_string("%.2f", unsigned)
    opening = F.format_string(REMARK_OPENING, theta, label)
    best, worst = F.col("_best"), F.col("_worst")
    both = F.format_string(
        REMARK_DOMAINS,
        best["domain_name"],
        _fixed(best["accuracy_pct"], 1),
        worst["domain_name"],
        _fixed(worst["accuracy_pct"], 1),
    )
    one = F.format_string(REMARK_ONE_DOMAIN, best["domain_name"], _fixed(best["accuracy_pct"], 1))
    text = (
        F.when(best.isNull(), F.format_string(REMARK_NO_DOMAIN, label, theta))
        .when(best["domain_id"] == worst["domain_id"], F.concat(opening, one))
        .otherwise(F.concat(opening, both))
    )
    return abilities.join(ends, SUBMISSION, "left").select(
        *SUBMISSION,
        best["domain_id"].alias("best_domain"),
        worst["domain_id"].alias("worst_domain"),
        text.alias("remark"),
    )


def diagnose(
    responses: DataFrame,
    domain_names: DataFrame,
    skills: DataFrame,
    targets: DataFrame,
    model: irt.ItemModel = DEFAULT_MODEL,
) -> dict[str, DataFrame]:
    """All result tables of the diagnostic report, for every submission at once.

    Answers are read and reduced once: the counts all tables share are kept on checkpoint storage.
    """
    by_skill = checkpointed(
        answer_counts(responses, [*SUBMISSION, "domain_id", "skill_id"], model)
    )
    by_domain = roll_up(by_skill, [*SUBMISSION, "domain_id"], model)
    by_submission = roll_up(by_domain, SUBMISSION, model)
    abilities = checkpointed(
        ability(by_submission, model).withColumn("placement_class", irt.placement(F.col("theta")))
    )
    domains = checkpointed(domain_scores(by_domain, abilities, domain_names, model))
    return {
        "abilities": abilities.select(*SUBMISSION, "theta", "placement_class", "total_questions"),
        "domain_scores": domains,
        "skill_priors": skill_priors(by_skill, domains, skills, model),
        "radar": radar_axes(domains, targets),
        "remarks": remarks(abilities, domains),
    }


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested row per submission. Its arrays are bounded by the domain and skill catalogs."""
    domains = tables["domain_scores"].groupBy(*SUBMISSION).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "first_seen", "domain_id", "domain_name", "theta_domain",
                    "total_questions", "correct_count", "accuracy_pct",
                )
            )
        ).alias("domain_scores")
    )
    priors = tables["skill_priors"].groupBy(*SUBMISSION).agg(
        F.sort_array(
            F.collect_list(F.struct("skill_id", "domain_id", "theta_skill", "p_l0", "source"))
        ).alias("skill_priors")
    )
    radar = tables["radar"].groupBy(*SUBMISSION).agg(
        F.sort_array(
            F.collect_list(F.struct("domain_id", "domain_name", "student_pct", "benchmark_pct"))
        ).alias("radar_chart")
    )
    out = tables["abilities"].withColumnRenamed("theta", "theta_0")
    for part in (domains, priors, radar, tables["remarks"].select(*SUBMISSION, "remark")):
        out = out.join(part, SUBMISSION, "left")
    return out
