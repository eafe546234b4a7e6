"""Queries over answers: ability, mastery, placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import irt
from gradus.operators import psychometrics as ops
from gradus.plans import query, views

_ITEMS = """items AS (
  SELECT *, CASE difficulty_level WHEN 1 THEN -1.8 WHEN 2 THEN -1.0 WHEN 3 THEN -0.2
              WHEN 4 THEN 0.6 WHEN 5 THEN 1.4 WHEN 6 THEN 2.2 ELSE 0.0 END::DOUBLE AS b,
         CASE WHEN time_spent_seconds < 5 THEN 0.1 ELSE 1.2 END::DOUBLE AS a,
         0.25::DOUBLE AS c
  FROM responses)"""


def _loss(theta: str) -> str:
    p = (
        "least(greatest(0.25 + 0.75 / (1 + exp(least(greatest(-x.a * "
        f"({theta} - x.b), -500), 500))), 1e-10), 1 - 1e-10)"
    )
    return (
        f"(list_sum(list_transform(cells, lambda x: -(x.r * ln({p}) + x.w * ln(1 - {p}))))"
        f" + 0.5 * ({theta} / 2) * ({theta} / 2))"
    )


def _golden(source: str, keys: str, out: str) -> str:
    """CTEs that estimate theta for each key of ``source`` by golden section."""
    r = "((sqrt(5.0) - 1) / 2)"
    return f"""
{out}_cells AS (
  SELECT {keys}, list(struct_pack(b := b, a := a, r := r, w := w) ORDER BY b, a) AS cells
  FROM (SELECT {keys}, b, a, CAST(count(*) FILTER (is_correct) AS DOUBLE) AS r,
               CAST(count(*) FILTER (NOT is_correct) AS DOUBLE) AS w
        FROM {source} GROUP BY {keys}, b, a) GROUP BY {keys}),
{out}_search AS (
  SELECT {keys}, cells, lo, h, xi, xo, {_loss('xi')} AS fi, {_loss('xo')} AS fo
  FROM (SELECT {keys}, cells, -3.0::DOUBLE AS lo, 6.0::DOUBLE AS h,
               -3.0 + (1 - {r}) * 6.0 AS xi, -3.0 + {r} * 6.0 AS xo FROM {out}_cells)
  UNION ALL
  SELECT {keys}, cells, lo, h, CASE WHEN lft THEN fresh ELSE kept END,
         CASE WHEN lft THEN kept ELSE fresh END,
         CASE WHEN lft THEN ff ELSE fk END, CASE WHEN lft THEN fk ELSE ff END
  FROM (SELECT *, {_loss('fresh')} AS ff
        FROM (SELECT *, lo + (CASE WHEN lft THEN 1 - {r} ELSE {r} END) * h AS fresh
              FROM (SELECT {keys}, cells, fi < fo AS lft, CASE WHEN fi < fo THEN lo ELSE xi END AS lo,
                           h * {r} AS h, CASE WHEN fi < fo THEN xi ELSE xo END AS kept,
                           CASE WHEN fi < fo THEN fi ELSE fo END AS fk
                    FROM {out}_search WHERE h > 1e-4)))),
{out} AS (
  SELECT {keys}, round(least(greatest(CASE WHEN fi < fo THEN xi ELSE xo END, -3), 3), 4) AS theta
  FROM {out}_search WHERE h <= 1e-4)"""


_PLACE = """CASE WHEN theta < -0.5 THEN 'FOUNDATION' WHEN theta > 0.5 THEN 'BREAKTHROUGH'
            ELSE 'ACCELERATION' END"""
_SUB = "student_id, submission_id"
_MASTERY = "greatest(0.05, least(0.95, 1 / (1 + exp(-({}))))) "

_DOMAIN_CTES = f"""{views.RESPONSES}, {views.DOMAIN_NAMES}, {_ITEMS},
{_golden('items', _SUB, 'overall')},
{_golden('items', _SUB + ', domain_id', 'domain_own')},
domains AS (
  SELECT g.student_id, g.submission_id, g.domain_id,
         coalesce(n.domain_name, CAST(g.domain_id AS VARCHAR)) AS domain_name,
         CASE WHEN g.total_questions >= 3 THEN d.theta ELSE o.theta END AS theta_domain,
         g.total_questions, g.correct_count,
         round_even(100.0::DOUBLE * (g.correct_count / g.total_questions), 2) AS accuracy_pct,
         g.first_seen
  FROM (SELECT {_SUB}, domain_id, count(*) AS total_questions,
               count(*) FILTER (is_correct) AS correct_count, min(answer_no) AS first_seen
        FROM items GROUP BY {_SUB}, domain_id) g
  JOIN domain_own d USING ({_SUB}, domain_id) JOIN overall o USING ({_SUB})
  LEFT JOIN domain_names n USING (domain_id))"""

_PRIOR_CTES = f"""{_DOMAIN_CTES}, {views.SKILLS},
{_golden('items', _SUB + ', domain_id, skill_id', 'skill_own')},
measured AS (
  SELECT g.student_id, g.submission_id, g.skill_id, g.domain_id,
         CASE WHEN n >= 2 THEN s.theta
              ELSE d.theta_domain + CASE WHEN r > 0 THEN 0.3 ELSE -0.3 END END AS t
  FROM (SELECT {_SUB}, domain_id, skill_id, count(*) AS n, count(*) FILTER (is_correct) AS r
        FROM items GROUP BY {_SUB}, domain_id, skill_id) g
  JOIN skill_own s USING ({_SUB}, domain_id, skill_id)
  JOIN domains d USING ({_SUB}, domain_id)),
inferred AS (
  SELECT k.student_id, k.submission_id, s.skill_id, s.domain_id, coalesce(d.theta_domain, 0) AS t
  FROM (SELECT DISTINCT {_SUB} FROM items) k CROSS JOIN skills s
  LEFT JOIN domains d USING ({_SUB}, domain_id)
  WHERE NOT EXISTS (SELECT 1 FROM measured m WHERE m.student_id = k.student_id
                    AND m.submission_id = k.submission_id AND m.skill_id = s.skill_id))"""


@query(
    "item_parameters",
    f"""WITH {views.RESPONSES}, {_ITEMS}
SELECT b, a, c, count(*) AS answers, count(*) FILTER (is_correct) AS right_answers
FROM items GROUP BY b, a, c""",
)
def item_parameters(spark: SparkSession, d: str) -> DataFrame:
    return (
        ops.item_parameters(views.responses(spark, d))
        .groupBy("b", "a", "c")
        .agg(
            F.count(F.lit(1)).alias("answers"),
            F.count(F.when(F.col("is_correct"), 1)).alias("right_answers"),
        )
    )


@query(
    "answer_statistics",
    f"""WITH {views.RESPONSES}, {_ITEMS}
SELECT student_id, submission_id, b, a, is_correct, count(*) AS answers
FROM items GROUP BY ALL""",
)
def answer_statistics(spark: SparkSession, d: str) -> DataFrame:
    return ops.item_cells(views.responses(spark, d), ops.SUBMISSION)


@query(
    "ability_on_grid",
    f"""WITH {views.RESPONSES}, {_ITEMS},
cells AS (SELECT {_SUB}, b, a, count(*) FILTER (is_correct) AS r, count(*) FILTER (NOT is_correct) AS w
          FROM items GROUP BY {_SUB}, b, a),
grid AS (SELECT -3.0::DOUBLE + g * 6.0::DOUBLE / 600 AS t FROM range(601) r(g)),
loss AS (SELECT {_SUB}, t, round(sum(-(r * ln(p) + w * ln(1 - p))) + 0.5 * (t / 2) * (t / 2), 9) AS f
         FROM (SELECT *, least(greatest(0.25 + 0.75 / (1 + exp(-a * (t - b))), 1e-10), 1 - 1e-10) AS p
               FROM cells, grid) GROUP BY {_SUB}, t),
best AS (SELECT {_SUB}, round(arg_min(t, struct_pack(f := f, t := t)), 4) AS theta
         FROM loss GROUP BY {_SUB})
SELECT student_id, submission_id, theta, {_PLACE} AS placement_class FROM best""",
)
def ability_on_grid(spark: SparkSession, d: str) -> DataFrame:
    found = ops.submission_ability(views.responses(spark, d), method="grid")
    return found.select(*ops.SUBMISSION, "theta", "placement_class")


@query(
    "ability",
    f"""WITH RECURSIVE {views.RESPONSES}, {_ITEMS}, {_golden('items', _SUB, 'overall')}
SELECT student_id, submission_id, theta, {_PLACE} AS placement_class FROM overall""",
)
def ability(spark: SparkSession, d: str) -> DataFrame:
    found = ops.submission_ability(views.responses(spark, d))
    return found.select(*ops.SUBMISSION, "theta", "placement_class")


@query(
    "placement_by_year",
    f"""WITH RECURSIVE {views.RESPONSES}, {_ITEMS}, {_golden('items', _SUB, 'overall')}
SELECT submission_id, {_PLACE} AS placement_class, count(*) AS students FROM overall GROUP BY ALL""",
)
def placement_by_year(spark: SparkSession, d: str) -> DataFrame:
    return ops.placement_counts(
        ops.submission_ability(views.responses(spark, d)), ["submission_id"]
    )


def _report(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return ops.diagnose(
        views.responses(spark, d),
        views.domain_names(spark, d),
        views.skills(spark, d),
        views.targets(spark, d),
    )


@query(
    "domain_scores",
    f"""WITH RECURSIVE {_DOMAIN_CTES}
SELECT student_id, submission_id, domain_id, domain_name, theta_domain, total_questions,
       correct_count, accuracy_pct FROM domains""",
)
def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)["domain_scores"].drop("first_seen")


@query(
    "skill_priors_measured",
    f"""WITH RECURSIVE {_PRIOR_CTES}
SELECT student_id, submission_id, skill_id, domain_id, round(t, 4) AS theta_skill,
       round({_MASTERY.format('t')}, 4) AS p_l0, 'measured' AS source FROM measured""",
)
def skill_priors_measured(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)["skill_priors"].where("source = 'measured'")


@query(
    "skill_priors_inferred",
    f"""WITH RECURSIVE {_PRIOR_CTES}
SELECT student_id, submission_id, skill_id, domain_id, round(t, 4) AS theta_skill,
       round({_MASTERY.format('t')}, 4) AS p_l0, 'inferred_from_domain' AS source FROM inferred""",
)
def skill_priors_inferred(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)["skill_priors"].where("source = 'inferred_from_domain'")


@query(
    "skill_priors_requested",
    f"""WITH RECURSIVE {_PRIOR_CTES},
requests AS (SELECT DISTINCT student_id, submission_id + 1 AS submission_id, skill_id FROM items),
found AS (
  SELECT r.student_id, r.submission_id, r.skill_id, coalesce(m.domain_id, s.domain_id) AS domain_id,
         coalesce(m.t, d.theta_domain, 0) AS t, m.skill_id IS NOT NULL AS own
  FROM requests r LEFT JOIN measured m USING ({_SUB}, skill_id) LEFT JOIN skills s USING (skill_id)
  LEFT JOIN domains d ON d.student_id = r.student_id AND d.submission_id = r.submission_id
                     AND d.domain_id = s.domain_id)
SELECT student_id, submission_id, skill_id, domain_id, round(t, 4) AS theta_skill,
       round({_MASTERY.format('t')}, 4) AS p_l0,
       CASE WHEN own THEN 'measured' ELSE 'inferred_from_domain' END AS source
FROM found WHERE domain_id IS NOT NULL""",
)
def skill_priors_requested(spark: SparkSession, d: str) -> DataFrame:
    """Priors, for the year after, of the skills that each sitting asked."""
    responses = views.responses(spark, d)
    tables = _report(spark, d)
    measured = tables["skill_priors"].where("source = 'measured'")
    after = (F.col("submission_id") + 1).alias("submission_id")
    requests = responses.select("student_id", after, "skill_id")
    return ops.requested_priors(requests, measured, tables["domain_scores"], views.skills(spark, d))


@query(
    "radar_axes",
    f"""WITH {views.RESPONSES}, {views.DOMAIN_NAMES}, {views.TARGETS}
SELECT student_id, submission_id, domain_id,
       coalesce(any_value(domain_name), CAST(domain_id AS VARCHAR)) AS domain_name,
       round_even(100.0::DOUBLE * (count(*) FILTER (is_correct) / count(*)), 2) AS student_pct,
       round_even(coalesce(any_value(target_score), 800) / 1200 * 100.0::DOUBLE, 2) AS benchmark_pct
FROM responses LEFT JOIN domain_names USING (domain_id) LEFT JOIN targets USING (student_id)
GROUP BY student_id, submission_id, domain_id""",
)
def radar_axes(spark: SparkSession, d: str) -> DataFrame:
    domains = ops.domain_accuracy(views.responses(spark, d), views.domain_names(spark, d))
    return ops.radar_axes(domains, views.targets(spark, d))


@query(
    "ability_standard_error",
    f"""WITH RECURSIVE {views.RESPONSES}, {_ITEMS}, {_golden('items', _SUB, 'overall')},
probs AS (SELECT *, 0.25 + 0.75 / (1 + exp(-a * (theta - b))) AS p
          FROM items JOIN overall USING ({_SUB}))
SELECT student_id, submission_id, any_value(theta) AS theta,
       round(1 / sqrt(sum(pow(a * (p - 0.25) * (1 - p) / 0.75, 2) / (p * (1 - p))) + 0.25), 4)
         AS standard_error
FROM probs GROUP BY {_SUB}""",
)
def ability_standard_error(spark: SparkSession, d: str) -> DataFrame:
    found = ops.submission_ability(views.responses(spark, d))
    return ops.standard_errors(found).select(*ops.SUBMISSION, "theta", "standard_error")


@query(
    "weak_skills",
    f"""WITH {views.RESPONSES}
SELECT student_id, submission_id, skill_id, count(*) AS total_questions,
       count(*) FILTER (is_correct) AS correct_count,
       round_even(100.0::DOUBLE * (count(*) FILTER (is_correct) / count(*)), 2) AS accuracy_pct
FROM responses GROUP BY student_id, submission_id, skill_id
HAVING round_even(100.0::DOUBLE * (count(*) FILTER (is_correct) / count(*)), 2) < 60""",
)
def weak_skills(spark: SparkSession, d: str) -> DataFrame:
    return ops.weak_skills(views.responses(spark, d))


_LABEL_SQL = (
    "CASE placement_class "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ops.PLACEMENT_LABELS.items())
    + " END"
)


@query(
    "diagnostic_remarks",
    f"""WITH RECURSIVE {_DOMAIN_CTES},
ends AS (
  SELECT {_SUB},
         arg_max(struct_pack(i := domain_id, n := domain_name, p := accuracy_pct),
                 struct_pack(p := accuracy_pct, f := -first_seen)) AS best,
         arg_min(struct_pack(i := domain_id, n := domain_name, p := accuracy_pct),
                 struct_pack(p := accuracy_pct, f := -first_seen)) AS worst
  FROM domains GROUP BY {_SUB}),
placed AS (SELECT *, {_PLACE} AS placement_class FROM overall)
SELECT student_id, submission_id, best.i AS best_domain, worst.i AS worst_domain,
  'Kết quả phân tích cho thấy năng lực tổng quan θ = ' || CASE WHEN theta < 0 AND theta > -0.005 THEN '-' ELSE '' END
  || CAST(round(CAST(theta AS DECIMAL(18, 4)), 2) AS VARCHAR)
  || '. Bạn được đề xuất tham gia ' || {_LABEL_SQL} || '. ' ||
  CASE WHEN best.i = worst.i
    THEN 'Lĩnh vực ''' || best.n || ''' đạt độ chính xác '
         || format('{{:.1f}}', round_even(best.p, 1)) || '%.'
    ELSE 'Thế mạnh nổi bật của bạn là ''' || best.n || ''' (độ chính xác '
         || format('{{:.1f}}', round_even(best.p, 1))
         || '%). Cần ưu tiên bổ trợ kiến thức ở lĩnh vực ''' || worst.n || ''' ('
         || format('{{:.1f}}', round_even(worst.p, 1))
         || '%) để đạt mục tiêu điểm thi mong đợi.' END AS remark
FROM placed JOIN ends USING ({_SUB})""",
)
def diagnostic_remarks(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)["remarks"]


@query(
    "diagnostic_report",
    f"""WITH RECURSIVE {_PRIOR_CTES}, {views.TARGETS},
priors AS (SELECT {_SUB}, count(*) AS skills, CAST(sum(CAST(round(p * 10000) AS BIGINT)) AS BIGINT) AS prior_sum FROM (
    SELECT {_SUB}, round({_MASTERY.format('t')}, 4) AS p FROM measured
    UNION ALL SELECT {_SUB}, round({_MASTERY.format('t')}, 4) FROM inferred) GROUP BY {_SUB}),
doms AS (SELECT {_SUB}, count(*) AS domains,
                string_agg(domain_name || '=' || format('{{:.4f}}', theta_domain), ';'
                           ORDER BY first_seen) AS domain_thetas
         FROM domains GROUP BY {_SUB})
SELECT student_id, submission_id, theta AS theta_0, {_PLACE} AS placement_class, domains,
       domain_thetas, skills, prior_sum,
       round_even(target_score / 1200 * 100.0::DOUBLE, 2) AS benchmark_pct
FROM overall JOIN priors USING ({_SUB}) JOIN doms USING ({_SUB}) JOIN targets USING (student_id)""",
)
def diagnostic_report(spark: SparkSession, d: str) -> DataFrame:
    rows = ops.report_rows(_report(spark, d))
    total = F.aggregate(
        "skill_priors",
        F.lit(0).cast("bigint"),
        lambda s, x: s + F.round(x["p_l0"] * 10_000).cast("bigint"),
    )
    parts = F.transform(
        "domain_scores",
        lambda x: F.concat(x["domain_name"], F.lit("="), F.format_string("%.4f", x["theta_domain"])),
    )
    return rows.select(
        *ops.SUBMISSION,
        "theta_0",
        "placement_class",
        F.size("domain_scores").cast("bigint").alias("domains"),
        F.array_join(parts, ";").alias("domain_thetas"),
        F.size("skill_priors").cast("bigint").alias("skills"),
        total.alias("prior_sum"),
        F.col("radar_chart")[0]["benchmark_pct"].alias("benchmark_pct"),
    )
