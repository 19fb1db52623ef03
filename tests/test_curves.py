import math
import random
import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import featloom as fl
from featloom.plans import ordered

from .conftest import counting

SCHEMA = "model string, y_true int, y_pred double"


def brute_force(examples):
    """Points (precision, recall, threshold) from the highest threshold down, and the average precision."""
    positives = sum(y for y, _ in examples)
    points, auc, before = [], 0.0, 0.0
    for t in sorted({s for _, s in examples}, reverse=True):
        hits = [y for y, s in examples if s >= t]
        precision = sum(hits) / len(hits)
        recall = sum(hits) / positives if positives else 1.0
        if positives:
            auc += (recall - before) * precision
        before = recall
        points.append((precision, recall, t))
    return points, auc


def steps(points):
    """Corners (recall, precision) of the full curve, closing point first."""
    full = [(0.0, 1.0)] + [(r, p) for p, r, _ in points]
    out = [full[0]]
    for (r0, _), (r1, p1) in zip(full, full[1:]):
        out += [(r0, p1), (r1, p1)]
    return out


def close(a, b):
    def flat(value):
        return [v for pair in value for v in pair] if isinstance(value, list) else value
    return flat(a) == pytest.approx(flat(b), abs=1e-12)


scores = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.25, 0.5, 0.9, 3.0])), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=scores, b=scores)
def test_curves_equal_brute_force(spark, a, b):
    models = {"a": a, "b": b}
    df = spark.createDataFrame([(m, y, s) for m, ex in models.items() for y, s in ex], SCHEMA)
    curve = fl.prc_curve(df, binary_as_point=False).orderBy("model", "point_idx").collect()
    corner = fl.prc_step_curve(df, binary_as_point=False).orderBy("model", "point_idx").collect()
    auc = {r.model: r.auc for r in fl.average_precision(df).collect()}
    for model, examples in models.items():
        points, expected_auc = brute_force(examples)
        mine = [r for r in curve if r.model == model]
        assert [r.point_idx for r in mine] == list(range(len(points)))
        assert close([(r.precision, r.recall, r.threshold) for r in mine], points)
        assert close(auc[model], expected_auc) and all(close(r.auc, expected_auc) for r in mine)
        assert {r.is_binary for r in mine} == {len(points) == 1}
        mine = [r for r in corner if r.model == model]
        assert [r.point_idx for r in mine] == list(range(2 * len(points) + 1))
        assert close([(r.recall, r.precision) for r in mine], steps(points))
        assert not any(r.is_binary for r in mine)


NUMBERS = [0.0, 5e-324, -5e-324, 2.2e-308, 1e-300, 0.1, 0.30000000000000004, 0.3, 1 - 2**-53, 1.0, 1 + 2**-52, 1.5, 2.0, 3.0, 1e9, 1e9 + 1, 2.0**53,
           1.7e308, math.inf, -0.1, -1.0, -1 - 2**-52, -1.5, -2.0, -1e9, -1.7e308, -math.inf] + [1 + k * 2**-40 for k in range(20)]


@pytest.mark.parametrize("bits", [ordered.DIGITS, (1, 2), (0, 3)])
def test_digits_keep_the_order_of_numbers(spark, bits):
    rng = random.Random(17)
    numbers = NUMBERS + [rng.uniform(-1, 1) * 2.0**rng.randint(-1060, 1020) for _ in range(3000)] + [1 + rng.random() * 2**-20 for _ in range(1000)]
    numbers += [s * 2.0**k * (1 + d * 2**-52) for k in range(-1000, 1000, 7) for d in (0, 1) for s in (1, -1)]
    numbers += [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 7)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    out = sorted((r.x, (r.d1, r.d2)) for r in df.select("x", *(c.alias(f"d{k}") for k, c in enumerate(ordered._digits(F.col("x"), bits), 1))).collect())
    assert all(a[1] <= b[1] for a, b in zip(out, out[1:]))
    if bits == ordered.DIGITS:  # 31 bits of the mantissa are told apart
        assert len({d for _, d in out}) > 4000


@pytest.mark.parametrize("bits", [ordered.DIGITS, (1, 2), (0, 1)])
def test_running_totals_over_any_numbers(spark, monkeypatch, bits):
    rng = random.Random(5)
    rows = [(m, x, rng.randrange(5)) for m in ("a", None) for x in NUMBERS + [round(rng.random(), 4) for _ in range(200)]]
    rows = list({(m, x): (m, x, v) for m, x, v in rows}.values())
    df = spark.createDataFrame(rows, "g string, x double, v int").repartition(5)
    out = ordered.running_totals(df, ["g"], "x", {"upto": F.col("v"), "rank": F.lit(1)}, {"all": F.col("v")}, digits=bits).collect()
    assert len(out) == len(rows)
    for r in out:
        mine = [v for m, x, v in rows if m == r.g and x >= r.x]
        assert (r.upto, r.rank) == (sum(mine), len(mine)) and r["all"] == sum(v for m, _, v in rows if m == r.g)


def test_planning_runs_no_job_and_stores_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("m", i % 2, float(i)) for i in range(50)], SCHEMA)
    df, seen = counting(df, spark)
    group = "curve-planning"
    spark.sparkContext.setJobGroup(group, "")
    try:
        curves = [fl.prc_curve(df), fl.prc_step_curve(df), fl.average_precision(df)]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group) and seen.value == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for curve in curves:
        before = seen.value
        curve.collect()
        assert seen.value - before == 50  # the scores are computed once, whatever is made of them


def binary(spark, data):
    return spark.createDataFrame([("m", y, s) for y, s in data], SCHEMA)


def test_binary_predictor_is_one_point(spark):
    df = binary(spark, [(1, 4.0), (0, 4.0), (1, 1.0), (0, 1.0), (1, 4.0)])
    row = fl.prc_curve(df).collect()
    assert len(row) == 1
    # the threshold is half the distance of the two scores
    assert (row[0].precision, row[0].recall, row[0].threshold, row[0].is_binary) == (2 / 3, 2 / 3, 1.5, True)
    step = fl.prc_step_curve(df).collect()
    assert [(r.point_idx, r.recall, r.precision, r.is_binary) for r in step] == [(0, 2 / 3, 2 / 3, True)]
    assert fl.prc_curve(df, binary_as_point=False).count() == 2


def test_constant_predictor_is_binary(spark):
    df = binary(spark, [(1, 2.0), (0, 2.0)])
    row, = fl.prc_curve(df).collect()
    assert (row.precision, row.recall, row.threshold, row.is_binary, row.auc) == (0.5, 1.0, 0.0, True, 0.5)


def test_no_positives(spark):
    df = binary(spark, [(0, 1.0), (0, 2.0), (0, 3.0)])
    assert {(r.precision, r.recall, r.auc) for r in fl.prc_curve(df).collect()} == {(0.0, 1.0, 0.0)}
    row, = fl.prc_curve(df.where("y_pred < 3")).collect()
    assert (row.precision, row.recall, row.auc) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("bad", [("m", 1, None), ("m", 1, float("nan")), ("m", None, 1.0), ("m", 2, 1.0)])
def test_bad_values_fail(spark, bad):
    df = spark.createDataFrame([("m", 0, 0.5), bad], SCHEMA)
    with pytest.raises(PySparkException, match="y_pred|y_true"):
        fl.prc_curve(df).collect()


def test_wide_inputs_and_labels(spark):
    df = spark.createDataFrame([(True, 0, 0.1, 0.9), (False, 1, 0.2, 0.3), (True, 1, 0.8, 0.4)],
                               "t boolean, u int, s1 double, `s.2` double")
    assert {r.model for r in fl.get_prc_curve_df(df, "t", ["s1", "s.2"]).collect()} == {"s1", "s.2"}
    both = fl.get_prc_step_curve_df(df, ["t", "u"], ["s1", "s.2"], labels=[1, 2])
    assert {r.model for r in both.collect()} == {1, 2}
    assert fl.get_prc_curve_df_single(df, "t", "s1").columns == [
        "point_idx", "precision", "recall", "threshold", "is_binary", "auc"]
    assert fl.get_prc_step_curve(df, "t", "s1").count() == 7
    assert "model" not in fl.get_prc_step_curve_df_single(df, "t", "s1").columns
    with pytest.raises(ValueError):
        fl.scores_long(df, ["t"], ["s1", "s.2"])


def test_step_points_of_any_curve(spark):
    curve = spark.createDataFrame([("m", 0, 1.0, 0.0), ("m", 1, 0.5, 0.4), ("m", 2, 0.7, 1.0)],
                                  "model string, point_idx long, precision double, recall double")
    out = [(r.point_idx, r.recall, r.precision) for r in fl.step_points(curve).orderBy("point_idx").collect()]
    assert out == [(0, 0.0, 1.0), (1, 0.0, 0.5), (2, 0.4, 0.5), (3, 0.4, 0.7), (4, 1.0, 0.7)]


def test_windows_are_bounded_by_digits(spark):
    df = spark.createDataFrame([("m", i % 2, float(i)) for i in range(50)], SCHEMA)
    plan = fl.prc_curve(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    # the rows themselves are ordered within both digits
    assert re.search(r"Window .*windowspecdefinition\(__group#\d+, __digit1#\d+L?, __digit2#\d+L?, threshold", plan)


def test_null_models_are_models(spark, tmp_path):
    df = spark.createDataFrame([(m, k % 2, float(k)) for m in (None, "a") for k in range(3)], "model string, y_true int, y_pred double")
    df.write.parquet(str(tmp_path / "scores"))
    df = spark.read.parquet(str(tmp_path / "scores"))
    for build in (fl.prc_curve, fl.prc_step_curve, fl.average_precision):
        assert {r.model for r in build(df).collect()} == {None, "a"}
    assert fl.prc_curve(df).count() == 6
    steps = fl.step_points(fl.prc_curve(df, binary_as_point=False))
    assert steps.count() == 10 and steps.where("recall IS NULL").count() == 0


def test_step_points_compute_the_curve_once(spark):
    scores, seen = counting(spark.createDataFrame([("m", i % 2, float(i)) for i in range(50)], SCHEMA), spark)
    assert len(fl.step_points(fl.prc_curve(scores)).collect()) == 99 and seen.value == 50


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_partitioned_by_model_are_dealt_anew(spark):
    df = spark.createDataFrame([(m, i % 2, float(i)) for m in ("a", None) for i in range(20)], SCHEMA).repartition("model")
    # the grouping of equal scores has an exchange of its own, by model and score
    assert re.search(r"Exchange hashpartitioning\(__group#\d+, (knownfloatingpointnormalized\()?.*threshold#", planned(fl.prc_curve(df)))
    assert len(fl.prc_curve(df).collect()) == 40


def test_sliced_scores_are_dealt_by_score_as_well(spark, sf_dir):
    from featloom.catalog import QUERIES
    plan = planned(QUERIES["pr_curve_null_model_sliced"](spark, sf_dir))
    by = re.findall(r"Exchange hashpartitioning\(([^)]*)\), REPARTITION_BY_NUM", plan)
    assert by and all("y_pred" in b for b in by)


def test_no_join_and_no_hash_table_holds_a_whole_model(spark):
    df = spark.createDataFrame([(m, i % 2, float(i)) for m in ("a", None) for i in range(20)], SCHEMA)
    plan = planned(fl.prc_curve(df))
    joins = re.findall(r"Join \[([^\]]*)\]", plan)
    assert joins and all("__digit1" in keys for keys in joins)
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*__digit2", plan)


def test_points_of_a_step_curve_are_dealt_out_before_they_are_grouped(spark):
    curve = spark.createDataFrame([("m", 0, 1.0, 0.0), ("m", 1, 0.5, 0.4)], "model string, point_idx long, precision double, recall double")
    assert re.search(r"Exchange hashpartitioning\(model#\d+, at#\d+L?, \d+\), REPARTITION_BY_COL", planned(fl.step_points(curve)))
