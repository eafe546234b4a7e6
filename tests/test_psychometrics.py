import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradus.functions import irt
from gradus.operators import psychometrics as ops

SCHEMA = (
    "student_id string, submission_id int, answer_no bigint, question_id bigint, skill_id string, "
    "domain_id string, difficulty_level int, is_correct boolean, time_spent_seconds int"
)


def answers(spark, items, student="s"):
    data = [
        (student, 1, i, i, skill, domain, level, right, seconds)
        for i, (skill, domain, level, right, seconds) in enumerate(items)
    ]
    return spark.createDataFrame(data, SCHEMA)


def loss(theta, items):
    total = 0.5 * (theta / 2) ** 2
    for _, _, level, right, seconds in items:
        b, a = irt.DIFFICULTY.get(level, 0.0), 0.1 if seconds < 5 else 1.2
        p = 0.25 + 0.75 / (1 + math.exp(-a * (theta - b)))
        total -= math.log(p if right else 1 - p)
    return total


def theta_of(spark, items, method="refined"):
    return ops.submission_ability(answers(spark, items), method=method).first()["theta"]


def test_probability_and_mastery(spark):
    value = spark.range(1).select(
        irt.probability(F.lit(0.0), F.lit(0.0), F.lit(1.2)),
        irt.probability(F.lit(3.0), F.lit(-1.2), F.lit(1.2)),
        irt.probability(F.lit(-3.0), F.lit(1.6), F.lit(1.2)),
        irt.mastery(F.lit(10.0)), irt.mastery(F.lit(-10.0)), irt.mastery(F.lit(0.0)),
    ).first()
    assert value[0] == pytest.approx(0.625)
    assert value[1] > 0.98
    assert value[2] == pytest.approx(0.25, abs=0.05)
    assert tuple(value[3:]) == (0.95, 0.05, 0.5)


def test_all_right_and_all_wrong(spark):
    right = [(f"k{i % 5}", "d", i % 4 + 1, True, 60) for i in range(30)]
    assert theta_of(spark, right) > 2.0
    assert theta_of(spark, [(k, d, n, False, t) for k, d, n, _, t in right]) < -2.0


def test_rapid_answers_count_less(spark):
    slow = [("k", "d", 2, True, 60)] * 10
    assert theta_of(spark, slow) > theta_of(spark, [("k", "d", 2, True, 2)] * 10)


def test_theta_is_the_minimum(spark):
    rng = np.random.default_rng(7)
    for _ in range(5):
        items = [
            ("k", "d", int(rng.integers(1, 8)), bool(rng.integers(0, 2)), int(rng.integers(1, 30)))
            for _ in range(20)
        ]
        grid = np.linspace(-3, 3, 6001)
        best = grid[np.argmin([loss(t, items) for t in grid])]
        assert theta_of(spark, items) == pytest.approx(best, abs=2e-3)
        assert theta_of(spark, items, "grid") == pytest.approx(best, abs=6e-3)


def test_no_answers_give_zero():
    empty = np.zeros((1, 28))
    assert irt.refined_theta(empty, ops.DEFAULT_MODEL)[0] == 0.0
    assert irt.grid_theta(empty, ops.DEFAULT_MODEL)[0] == 0.0


def test_placement_bounds(spark):
    data = [(-1.2,), (-0.51,), (-0.5,), (0.0,), (0.5,), (0.51,), (2.1,)]
    got = [r[0] for r in spark.createDataFrame(data, "t double").select(irt.placement(F.col("t"))).collect()]
    assert got == ["FOUNDATION"] * 2 + ["ACCELERATION"] * 3 + ["BREAKTHROUGH"] * 2


def test_untested_skill_takes_domain_theta(spark):
    taken = answers(spark, [("tested", "d1", 2, True, 30), ("tested", "d1", 3, True, 30)])
    skills = spark.createDataFrame([("tested", "d1"), ("untested", "d1"), ("far", "d9")], "skill_id string, domain_id string")
    names = spark.createDataFrame([("d1", "Maths")], "domain_id string, domain_name string")
    targets = spark.createDataFrame([("s", 900)], "student_id string, target_score int")
    tables = ops.diagnose(taken, names, skills, targets)
    domain = tables["domain_scores"].first()
    overall = tables["abilities"].first()["theta"]
    assert domain["theta_domain"] == overall and domain["domain_name"] == "Maths"
    priors = {r["skill_id"]: r for r in tables["skill_priors"].collect()}
    assert priors["tested"]["source"] == "measured"
    assert priors["untested"]["source"] == "inferred_from_domain"
    expected = min(max(1 / (1 + math.exp(-overall)), 0.05), 0.95)
    assert priors["untested"]["p_l0"] == pytest.approx(expected, abs=1e-4)
    assert priors["far"]["theta_skill"] == 0.0
    assert tables["radar"].first()["benchmark_pct"] == 75.0


def test_single_item_skill_is_shifted(spark):
    items = [("a", "d", 2, True, 30), ("b", "d", 2, False, 30), ("c", "d", 2, True, 30)]
    names = spark.createDataFrame([], "domain_id string, domain_name string")
    skills = spark.createDataFrame([("a", "d")], "skill_id string, domain_id string")
    targets = spark.createDataFrame([("s", 800)], "student_id string, target_score int")
    tables = ops.diagnose(answers(spark, items), names, skills, targets)
    theta = tables["domain_scores"].first()["theta_domain"]
    got = dict(rows(tables["skill_priors"], "skill_id", "theta_skill"))
    assert got["a"] == pytest.approx(theta + 0.3) and got["b"] == pytest.approx(theta - 0.3)


def test_radar_needs_no_ability(spark):
    from gradus.plans.psychometrics import radar_axes

    items = [(f"k{i % 6}", f"d{i % 3}", i % 6 + 1, [True, False, None][i % 4 % 3], 40) for i in range(31)]
    names = spark.createDataFrame([("d0", "N0"), ("d1", "N1")], "domain_id string, domain_name string")
    targets = spark.createDataFrame([("x", 900)], "student_id string, target_score int")
    skills = spark.createDataFrame([("k0", "d0")], "skill_id string, domain_id string")
    taken = answers(spark, items)
    alone = ops.radar_axes(ops.domain_accuracy(taken, names), targets)
    assert rows(alone) == rows(ops.diagnose(taken, names, skills, targets)["radar"]) != []
    # The query reads answers itself: no stored ability before it, no Python in it.
    plan = radar_axes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "lineitem" in plan and "Arrow" not in plan and "Python" not in plan


def test_report_end_to_end(spark):
    items = [(f"k{i % 6}", f"d{i % 3}", i % 6 + 1, i % 2 == 0, 40) for i in range(30)]
    names = spark.createDataFrame([(f"d{i}", f"N{i}") for i in range(3)], "domain_id string, domain_name string")
    skills = spark.createDataFrame([(f"k{i}", f"d{i % 3}") for i in range(8)], "skill_id string, domain_id string")
    targets = spark.createDataFrame([("s", 900)], "student_id string, target_score int")
    report = ops.report_rows(ops.diagnose(answers(spark, items), names, skills, targets)).first()
    assert -3 <= report["theta_0"] <= 3
    assert len(report["domain_scores"]) == 3 and len(report["radar_chart"]) == 3
    assert len(report["skill_priors"]) == 8
    assert "Thế mạnh nổi bật" in report["remark"]


def test_requested_priors(spark):
    measured = spark.createDataFrame(
        [("s", 1, "a", "alg", 0.7, 0.66)],
        "student_id string, submission_id int, skill_id string, domain_id string, theta_skill double, p_l0 double",
    )
    domains = spark.createDataFrame(
        [("s", 1, "alg", 0.5), ("t", 1, "geo", -1.0)],
        "student_id string, submission_id int, domain_id string, theta_domain double",
    )
    skills = spark.createDataFrame(
        [("a", "alg"), ("b", "alg"), ("c", "geo"), ("c", "geo")], "skill_id string, domain_id string"
    )
    asked = [("s", 1, k) for k in ("a", "b", "b", "c", "unknown")] + [("t", 1, "c"), ("new", 9, "b")]
    requests = spark.createDataFrame(asked, "student_id string, submission_id int, skill_id string")
    got = {
        (r.student_id, r.skill_id): (r.domain_id, r.theta_skill, r.p_l0, r.source)
        for r in ops.requested_priors(requests, measured, domains, skills).collect()
    }
    inferred = "inferred_from_domain"
    assert got == {
        ("s", "a"): ("alg", 0.7, 0.66, "measured"),
        ("s", "b"): ("alg", 0.5, 0.6225, inferred),
        ("s", "c"): ("geo", 0.0, 0.5, inferred),
        ("t", "c"): ("geo", -1.0, 0.2689, inferred),
        ("new", "b"): ("alg", 0.0, 0.5, inferred),
    }


def test_ability_that_rounds_to_zero_has_no_sign():
    values = irt._rounded(np.array([-0.00001, -0.0, 0.00001, -0.00006]))
    assert [f"{v:.2f}" for v in values] == ["0.00", "0.00", "0.00", "-0.00"]
    draw = np.random.default_rng(3)
    counts = draw.integers(0, 4, (20000, 2 * len(irt.ItemModel().cells))).astype(float)
    for solve in (irt.refined_theta, irt.grid_theta):
        found = solve(counts, irt.ItemModel())
        assert not np.signbit(found[found == 0]).any()


def test_equal_counts_are_solved_once():
    model = irt.ItemModel()
    counts = np.zeros((40, len(model.count_columns)))
    counts[np.arange(40), np.arange(40) % 3] = 2
    counts[7, 1] = 300  # beyond one byte
    distinct, at = irt.different(counts)
    assert len(distinct) == 4 and (distinct[at] == counts).all()
    assert (irt.refined_theta(distinct, model)[at] == irt.refined_theta(counts, model)).all()


def test_keys_below_the_least_answers_do_not_go_through_python(spark):
    items = [("a", "d", 3, True, 30), ("a", "d", 5, False, 30), ("b", "d", 2, True, 30)]
    counts = ops.answer_counts(answers(spark, items), [*ops.SUBMISSION, "skill_id"])
    found = ops.ability(counts, min_items=2)
    got = {r.skill_id: r.theta for r in found.collect()}
    assert got["b"] == 0.0 and got["a"] == theta_of(spark, items[:2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("ArrowEvalPython")[1]


def test_report_keeps_the_sign_of_a_zero_ability_and_remarks_drop_it(spark):
    # (part, right, seconds) of a sitting on the supplied tables: its ability is just below zero.
    taken = [
        (8401, 1, 2), (15249, 1, 36), (18402, 1, 28), (14578, 1, 38), (17347, 0, 46), (10641, 1, 13),
        (3128, 1, 36), (18812, 1, 38), (1450, 0, 11), (7150, 0, 10), (12034, 1, 34), (8677, 1, 22),
        (6802, 0, 43), (16402, 0, 40), (1719, 1, 35), (3454, 0, 44), (11574, 1, 36), (7683, 1, 39),
    ]
    items = [(f"k{p % 25:02}", f"d{p % 5}", p % 7 + 1, bool(right), t) for p, right, t in taken]
    names = spark.createDataFrame([], "domain_id string, domain_name string")
    skills = spark.createDataFrame([("k10", "d0"), ("k29", "d4")], "skill_id string, domain_id string")
    targets = spark.createDataFrame([("s", 900)], "student_id string, target_score int")
    tables = ops.diagnose(answers(spark, items), names, skills, targets)
    report = ops.report_rows(tables).first()
    assert f"{report['theta_0']:.4f}" == "-0.0000"
    domains = [f"{d['domain_id']}={d['theta_domain']:.4f}" for d in report["domain_scores"]]
    assert domains == ["d1=-0.0000", "d4=1.0693", "d2=-1.2717", "d3=2.1455", "d0=-0.0000"]
    untested = {p["skill_id"]: p["theta_skill"] for p in report["skill_priors"]}["k10"]
    assert f"{untested:.4f}" == "-0.0000"
    assert "θ = 0.00." in report["remark"]


def test_four_digits_keep_the_sign_of_zero(spark):
    data = [(-0.00001,), (-0.0,), (0.0,), (0.00001,), (-0.00006,), (1.23456,), (None,)]
    got = spark.createDataFrame(data, "t double").select(irt.four_digits(F.col("t"))).collect()
    assert [str(r[0]) for r in got] == ["-0.0", "-0.0", "0.0", "0.0", "-0.0001", "1.2346", "None"]
