import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

import featloom as fl

from .conftest import rows

# Documented names of both sides and the matches they must give.
REF = ["X - T", "X - T", "Y - A"]
ALT = ["Y___A", "Y___A", "B_Y", "X___T", "X___T", None]
MATCHED = ["Y - A", "Y - A", None, "X - T", "X - T", None]


def names(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id int, name string")


def test_match_to_reference(spark):
    out = fl.fuzzy_match_to_reference(names(spark, REF), names(spark, ALT))
    assert [r.ref_name for r in out.orderBy("row_id").collect()] == MATCHED
    assert out.columns == ["row_id", "name", "ref_name"]


def test_match_names_both_sides(spark):
    out = fl.fuzzy_match_names(names(spark, REF), names(spark, ALT))
    assert rows(out) == [("by", None, "B_Y"), ("xt", "X - T", "X___T"), ("ya", "Y - A", "Y___A")]


def test_ambiguous_names_fail(spark):
    for ref, alt in ((["a b", "a_b"], ["x"]), (["x"], ["A(b)", "ab"])):
        with pytest.raises(PySparkException, match="non-unique names"):
            fl.fuzzy_match_to_reference(names(spark, ref), names(spark, alt)).collect()


def test_normal_form_uses_unicode_whitespace(spark):
    df = names(spark, ["A b", "C (d)", "e\x1cF", "Ü-x"])
    assert {r.norm for r in fl.str_normalize(df).collect()} == {"ab", "cd", "ef", "üx"}
    assert rows(fl.str_normalize(names(spark, ["a.b"]), regex=r"[\s.]", replace="~")) == [("a~b", "a.b")]


@pytest.fixture(scope="module")
def table(spark):
    data = [(float(x), float(x % 3), 2.0 * x - (x % 3) + 1, int(x > 10)) for x in range(24)]
    return spark.createDataFrame(data, "`f.x` double, z double, y double, c int")


def test_zscore_regressor(table):
    model = fl.ZscoreRegressor("pyspark.ml.regression.LinearRegression", solver="normal").fit(table, ["f.x", "z"], "y")
    for row in model.predict_proba(table).collect():
        assert row.score == pytest.approx(-row.y, abs=1e-6)
    assert model.predict(table).columns == [*table.columns, "prediction"]
    assert model.get_params()["model_class"] is LinearRegression and model.numFeatures == 2
    assert "ZscoreRegressor(" in repr(model)


def test_binary_classifier(table):
    model = fl.fit_model(table, LogisticRegression(regParam=0.01), ["f.x"], "c", fl.BinaryClassifier)
    scored = fl.score_model(table, model)
    assert rows(scored.select("score")) == rows(model.predict(table).select("prediction"))
    low, high = (scored.where(F.col("c") == c).agg(F.avg("score")).collect()[0][0] for c in (0, 1))
    assert 0 <= low < 0.2 and 0.8 < high <= 1


def test_binary_classifier_needs_two_classes(table):
    three = table.withColumn("c", F.col("z").cast("int"))
    model = fl.fit_model(three, LogisticRegression(), ["f.x"], "c", fl.BinaryClassifier)
    with pytest.raises(ValueError, match="2 classes"):
        model.predict_proba(three)


def test_plain_wrapper_gives_all_probabilities(table):
    model = fl.ModelWrapper(model_instance=LogisticRegression()).fit(table, ["f.x"], "c")
    assert all(sum(r.score) == pytest.approx(1) for r in model.predict_proba(table).collect())
    with pytest.raises(ImportError):
        fl.ModelWrapper("LinearRegression")


def test_null_regressor(spark):
    df = spark.createDataFrame([(1, 2.0, 6), (2, None, 3)], "id int, `a.b` double, c int")
    model = fl.NullRegressor().fit(df, ["a.b", "c"])
    assert [r.score for r in model.predict_proba(df).collect()] == [4.0, None]
    assert rows(model.predict(df, "m").select("m")) == [(None,), (4.0,)] and model.get_params() == {}
    with pytest.raises(ValueError):
        fl.NullRegressor().predict(df)
