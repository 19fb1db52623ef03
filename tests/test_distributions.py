import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import featloom as fl
from featloom.functions.special import log_choose, negbin_cdf

from .conftest import rows


def exact_pmf(mean, r, x):
    return math.exp(math.lgamma(r + x) - math.lgamma(r) - math.lgamma(x + 1)
                    + r * math.log(r / (r + mean)) + x * math.log(mean / (r + mean)))


CDF_CASES = {(5, 2, 3): 0.442197, (50, 10, 70): 0.877856, (1000, 3, 900): 0.506852, (0.5, 0.7, 0): 0.685712,
             (20, 1.5, 100): 0.997853}


def test_cdf_fixtures_in_spark(spark):
    df = spark.createDataFrame([(float(m), float(r), float(k)) for m, r, k in CDF_CASES], "mean double, r double, x double")
    got = [r[0] for r in df.select(fl.NegativeBinomial(mean="mean", r="r").cdf("x")).collect()]
    assert got == pytest.approx(list(CDF_CASES.values()), abs=1e-6)


@pytest.mark.parametrize("mean, r", [(5.0, 2.0), (0.3, 0.05), (40.0, 300.0), (900.0, 0.7), (3.0, 1e9)])
def test_cdf_is_the_sum_of_probabilities(mean, r):
    x = np.arange(0.0, 3 * mean + 60)
    cdf, log_cdf = negbin_cdf(x, np.full_like(x, mean), np.full_like(x, r))
    summed = np.cumsum([exact_pmf(mean, r, k) if r < 1e8 else math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
                        for k in x])
    assert cdf == pytest.approx(summed, abs=1e-8 if r > 1e8 else 1e-10)
    assert np.exp(log_cdf) == pytest.approx(cdf, rel=1e-9)
    assert np.all(np.diff(cdf) >= 0)


def test_cdf_with_large_means():
    # at the mean of a nearly symmetric distribution the CDF is a half, with a known skew term
    for size in (1e5, 1e7):
        cdf, _ = negbin_cdf(np.array([size]), np.array([size]), np.array([size]))
        assert 0.5 < cdf[0] < 0.5 + 2 / math.sqrt(size)


def test_cdf_edges():
    x = np.array([-1.0, -0.5, 2.7, np.inf, 2.0, 2.0, 2.0, np.nan])
    r = np.array([2.0, 2.0, 2.0, 2.0, np.nan, -1.0, 0.0, 2.0])
    cdf, log_cdf = negbin_cdf(x, np.full_like(x, 5.0), r)
    whole, _ = negbin_cdf(np.array([2.0]), np.array([5.0]), np.array([2.0]))
    assert cdf[0] == cdf[1] == 0.0 and log_cdf[0] == -np.inf and cdf[2] == whole[0] and cdf[3] == 1.0
    assert np.isnan(cdf[4:]).all()


def test_far_tail_keeps_its_logarithm():
    _, log_cdf = negbin_cdf(np.array([0.0]), np.array([1e4]), np.array([200.0]))
    assert log_cdf[0] == pytest.approx(200 * math.log(200 / 10200), rel=1e-12)


def test_log_choose_against_lgamma():
    for r in (1e-3, 0.4, 7.0, 250.0, 1e5):
        for x in (0.0, 0.5, 3.0, 80.0, 1e4):
            expected = math.lgamma(r + x) - math.lgamma(r) - math.lgamma(x + 1)
            got = float(log_choose(np.float64(r), np.float64(x), np.log, np.log1p))
            assert got == pytest.approx(expected, rel=1e-10, abs=1e-8)


def test_probabilities_in_spark(spark):
    cases = [(5.0, 2.0, 3.0), (0.2, 0.4, 0.0), (70.0, 9.0, 120.0), (5.0, 2.0, 2.5)]
    nb = fl.NegativeBinomial(mean="mean", r="r")
    df = spark.createDataFrame(cases, "mean double, r double, x double")
    for row, (mean, r, x) in zip(df.select(nb.log_prob("x"), nb.prob("x")).collect(), cases):
        assert row[1] == pytest.approx(exact_pmf(mean, r, x), rel=1e-12)
        assert row[0] == pytest.approx(math.log(exact_pmf(mean, r, x)), rel=1e-12)
    outside = spark.createDataFrame([(5.0, 2.0, -1.0), (5.0, None, 1.0), (5.0, -2.0, 1.0)], "mean double, r double, x double")
    assert [r[0] for r in outside.select(nb.log_prob("x")).collect()] == [-math.inf, None, None]


def test_log_prob_stays_compiled(spark, sf_dir):
    """Java leaves methods above 8000 bytes of code uncompiled."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        fl.NegativeBinomial(mean="l_tax", r="l_discount").prob("l_quantity").alias("p"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    size = int(code.split("maxMethodCodeSize:")[1].split(";")[0])
    assert size < 8000


def test_pvalues(spark):
    df = spark.createDataFrame([(5.0, 2.0, float(x)) for x in range(40)], "mean double, r double, x double")
    nb = fl.NegativeBinomial(mean="mean", r="r")
    for less, greater, both, pmf in df.select(
            nb.pval("x", "less"), nb.pval("x", "greater"), nb.pval("x"), nb.prob("x")).collect():
        assert less + greater - pmf == pytest.approx(1.0, abs=1e-12)
        assert both == pytest.approx(2 * min(0.5, less, greater), abs=1e-12) and 0 <= both <= 1
    with pytest.raises(ValueError):
        nb.pval("x", "bigger")


@pytest.mark.parametrize("given", [{"r": 2, "mean": 5}, {"r": 2, "p": 5 / 7}, {"variance": 17.5, "mean": 5},
                                   {"variance": 17.5, "p": 5 / 7}])
def test_parameterisations_agree(spark, given):
    nb = fl.NegativeBinomial(**given)
    row = spark.range(1).select(nb.mean, nb.r, nb.variance, nb.p, nb.log_p, nb.log_1p).collect()[0]
    assert tuple(row) == pytest.approx((5, 2, 17.5, 5 / 7, math.log(5 / 7), math.log(2 / 7)))


@pytest.mark.parametrize("given", [{}, {"r": 1}, {"mean": 1}, {"r": 1, "variance": 2, "mean": 1},
                                   {"r": 1, "p": 0.5, "mean": 1}, {"variance": 1}, {"p": 0.5, "mean": 1}])
def test_wrong_parameters(given):
    with pytest.raises(ValueError):
        fl.NegativeBinomial(**given)


def test_fit_and_score_with_underdispersed_group(spark):
    data = [("over", float(v)) for v in (1, 1, 2, 9, 12)] + [("equal", 3.0)] * 4 + [("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    fit = {r.g: r for r in fl.nb_fit(df, ["g"], "v").collect()}
    values = np.array([1, 1, 2, 9, 12.0])
    over = fit["over"]
    assert (over.n, over.mean, over.variance) == (5, 5.0, pytest.approx(values.var()))
    assert over.r == pytest.approx(25 / (values.var() - 5)) and over.overdispersed
    assert fit["equal"].r is None and not fit["equal"].overdispersed and fit["none"].mean is None
    scored = fl.nb_score(df, fl.nb_fit(df, ["g"], "v"), ["g"], "v")
    got = {(r.g, r.v): r for r in scored.collect()}
    assert got[("equal", 3.0)].pval is None and got[("equal", 3.0)].cdf is None and got[("equal", 3.0)].log_prob is None
    assert got[("over", 9.0)].prob == pytest.approx(exact_pmf(5.0, over.r, 9))
    assert not any(g is None for g, _ in got)  # a null key meets no parameters


def test_mme_inside_an_aggregation(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (0, 0, 1, 9)], "g string, v double")
    fit = fl.NegativeBinomial.mme("v")
    row = df.groupBy("g").agg(fit.mean, fit.r, fit.variance, fit.p).collect()[0]
    variance = np.var([0, 0, 1, 9])
    assert tuple(row)[1:] == pytest.approx((2.5, 6.25 / (variance - 2.5), variance, 1 - 2.5 / variance))


def test_only_the_cdf_uses_python(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    params = fl.nb_fit(lines, ["l_suppkey"], "l_quantity")
    def plan(measure):
        return fl.nb_apply(lines, params, ["l_suppkey"], "l_quantity", measure)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan("log_prob") and "Python" not in plan("prob")
    assert plan("cdf").count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan("prob")
    scored = fl.nb_score(lines, params, ["l_suppkey"], "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert scored.count("ArrowEvalPython") == 1


PARAMS = [("a", 5.0, 2.0), ("b", 300.0, 40.0), ("undefined", 5.0, None)]


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame(PARAMS, "k string, mean double, r double")


def test_nb_sample_moments_and_numbering(params):
    draws = fl.nb_sample(params, ["k"], size=9000, seed=3)
    for k, mean, r in PARAMS[:2]:
        row = draws.where(F.col("k") == k).agg(F.avg("value"), F.var_pop("value"), F.count("*"),
                                               F.min("draw"), F.max("draw"), F.count_distinct("draw")).collect()[0]
        variance = mean + mean * mean / r
        assert row[0] == pytest.approx(mean, abs=5 * math.sqrt(variance / 9000))
        assert row[1] == pytest.approx(variance, rel=0.15)
        assert tuple(row)[2:] == (9000, 0, 8999, 9000)
    assert draws.where("k = 'undefined'").count() == 0


@pytest.mark.parametrize("sampler", [
    lambda p: fl.nb_sample(p, ["k"], size=5000, seed=9),
    lambda p: fl.normal_sample(p.withColumn("sd", F.lit(2.0)), ["k"], size=5000, seed=9),
    lambda p: fl.beta_sample(p.select("k", F.lit(0.3).alias("mean"), F.lit(20).alias("samplesize")), ["k"], size=5000, seed=9)])
def test_samples_do_not_depend_on_partitioning(params, sampler):
    assert rows(sampler(params.coalesce(1))) == rows(sampler(params.repartition(7)))


def test_seeds_differ(params):
    assert rows(fl.nb_sample(params, ["k"], 50, 1)) != rows(fl.nb_sample(params, ["k"], 50, 2))


def test_normal_and_beta_moments(spark, params):
    normal = fl.normal_sample(params.withColumn("sd", F.lit(2.0)), ["k"], size=20000, seed=4).where("k = 'a'")
    mean, sd, skew = normal.agg(F.avg("value"), F.stddev("value"), F.skewness("value")).collect()[0]
    assert (mean, sd, skew) == (pytest.approx(5, abs=0.08), pytest.approx(2, rel=0.04), pytest.approx(0, abs=0.1))
    beta = fl.beta_sample(spark.createDataFrame([("b", 0.3, 20.0)], "k string, mean double, samplesize double"),
                          ["k"], size=20000, seed=4)
    mean, variance = beta.agg(F.avg("value"), F.var_pop("value")).collect()[0]
    assert (mean, variance) == (pytest.approx(0.3, abs=0.004), pytest.approx(0.3 * 0.7 / 21, rel=0.06))
    with pytest.raises(ValueError):
        fl.nb_sample(params, ["k"], 0)


def test_cdf_of_huge_numbers_keeps_its_digits():
    from featloom.functions.special import negbin_cdf
    for power in (9, 10, 11, 12):
        x, mean, r = (np.array([10.0**p]) for p in (power, power, power - 1))
        # at the mean: 1/2 + skewness term of the normal approximation
        sd = math.sqrt(mean[0] + mean[0]**2 / r[0])
        skew = (1 + 2 * mean[0] / r[0]) / sd
        expected = 0.5 + (skew / 6 + 0.5 / sd) / math.sqrt(2 * math.pi)
        assert abs(negbin_cdf(x, mean, r)[0][0] - expected) < 1e-8


def test_draws_do_not_depend_on_their_neighbours():
    from featloom.functions.sampling import Stream
    seeds = np.arange(1000, dtype=np.int64) * 7919
    shape, rate = np.linspace(0.1, 5, 1000), np.linspace(0.1, 200, 1000)
    for draw in (lambda s, k: s.gamma(shape[k]), lambda s, k: s.poisson(rate[k]), lambda s, k: s.beta(shape[k], shape[k])):
        whole = draw(Stream(seeds), slice(None))
        for part in (slice(0, 1), slice(500, 517), slice(990, 1000)):
            assert np.allclose(draw(Stream(seeds[part]), part), whole[part], rtol=1e-12)
