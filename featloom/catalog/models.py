"""Models."""

from pyspark.sql import functions as F

from ..operators import models
from .base import query


@query("null_regressor", """
SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS score FROM lineitem""")
def null_regressor(t):
    model = models.NullRegressor().fit(features=["l_quantity", "l_discount", "l_tax"])
    scored = model.predict_proba(t("lineitem"))
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("zscore_regressor", """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(-(a * l_quantity + b), 4) AS score FROM lineitem, m""")
def zscore_regressor(t):
    model = models.ZscoreRegressor("pyspark.ml.regression.LinearRegression", solver="normal")
    scored = model.fit(t("lineitem"), ["l_quantity"], "l_extendedprice").predict_proba(t("lineitem"))
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 4).alias("score"))


@query("binary_classifier", """
WITH d AS (SELECT quality, ln(1 + n_chars) AS x FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
SELECT count(*) AS n, round(sum(quality) / count(*), 3) AS mean_score, round(sum(x * quality) / count(*), 3) AS mean_product FROM d""")
def binary_classifier(t):
    """The fit without a penalty satisfies sum(score) = sum(y) and sum(x score) = sum(x y)."""
    data = t("labels").where("quality IS NOT NULL").join(t("documents").select("doc_id", F.log1p("n_chars").alias("x")), "doc_id")
    model = models.BinaryClassifier("pyspark.ml.classification.LogisticRegression", tol=1e-10, maxIter=200).fit(data, ["x"], "quality")
    scored = model.predict(data, "score")
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.round(F.avg(F.col("x") * F.col("score")), 3).alias("mean_product"))
