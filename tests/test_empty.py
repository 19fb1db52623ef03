"""Operators on frames without rows."""

from pyspark.sql import functions as F

import featloom as fl
from featloom.plans.skew import SkewPolicy


def test_curves(spark):
    scores = spark.createDataFrame([], "model string, y_true int, y_pred double")
    for build in (fl.prc_curve, fl.prc_step_curve, fl.average_precision):
        assert build(scores).count() == 0


def test_mask_without_true_cells(spark):
    mask = spark.createDataFrame([(1, 2, False)], "a int, b int, mask boolean")
    labels = fl.core_dim_labels_from_mask(mask, ["a", "b"], "n")
    assert labels.count() == 0
    variable = spark.createDataFrame([(1, 5)], "a int, value int")
    assert fl.subset_variable(variable, labels, ["a", "b"]).count() == 0


def test_feature_sets(spark):
    full, empty = spark.range(3).withColumn("v", F.lit(1)), spark.createDataFrame([], "id long, v int")
    for options in ({}, {"unique_keys": True}, {"spine": True}, {"skew": SkewPolicy(1, 1.0)}):
        out = fl.join_featuresets({"f": full, "e": empty}, {"f": ["v"], "e": ["v"]}, ["id"], **options)
        assert out.count() == 3 and out.where("`feature.e@v` IS NOT NULL").count() == 0


def test_distributions(spark):
    data = spark.createDataFrame([], "g string, v double")
    fit = fl.nb_fit(data, ["g"], "v")
    assert fit.count() == 0 and fl.nb_score(data, fit, ["g"], "v").count() == 0
    assert fl.nb_sample(fit, ["g"], 3).count() == 0
