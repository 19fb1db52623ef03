"""Precision-recall curves."""

from pyspark.sql import functions as F

from ..operators import curves
from ..plans.storage import shuffle_partitions
from .base import query

_DOCS = "SELECT quality AS y, {score}::DOUBLE AS score, '{score}' AS model FROM labels JOIN documents USING (doc_id)"
_LINES = "SELECT (l_returnflag = 'R')::INT AS y, {score}::DOUBLE AS score, '{score}' AS model FROM lineitem"
_LINE_SCORES = ["l_extendedprice", "l_quantity", "l_tax"]


def _counted(*sources: str) -> str:
    """Running counts per model and distinct score, by windows over the whole model."""
    return f"""
WITH s AS ({' UNION ALL '.join(sources)}),
     p AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM s GROUP BY model, score),
     w AS (SELECT *, sum(pos) OVER up AS tp, sum(n) OVER up AS pp, row_number() OVER up AS rk,
             sum(pos) OVER everything AS all_pos, count(*) OVER everything AS points,
             min(score) OVER everything AS low, max(score) OVER everything AS high
           FROM p WINDOW up AS (PARTITION BY model ORDER BY score DESC), everything AS (PARTITION BY model)),
     c AS (SELECT *, tp / pp AS prec, tp / all_pos AS rec,
             coalesce(lag(tp) OVER (PARTITION BY model ORDER BY score DESC), 0) / all_pos AS rec_before FROM w),
     auc AS (SELECT model, sum((rec - rec_before) * prec) AS auc FROM c GROUP BY model)
"""


def _points_sql(*sources: str, binary_as_point: bool) -> str:
    binary = "points <= 2" if binary_as_point else "false"
    return _counted(*sources) + f"""
SELECT model, rk - 1 AS point_idx, round(prec, 6) AS "precision", round(rec, 6) AS recall,
  round(CASE WHEN {binary} THEN (high - low) / 2 ELSE score END, 6) AS threshold,
  ({binary} OR points = 1) AS is_binary, round(auc, 6) AS auc
FROM c JOIN auc USING (model) WHERE NOT ({binary}) OR rk = 1"""


def _steps_sql(*sources: str, binary_as_point: bool) -> str:
    binary = "points <= 2" if binary_as_point else "false"
    return _counted(*sources) + f""",
     r AS (SELECT *, ({binary}) AS is_binary FROM c JOIN auc USING (model)),
     steps AS (
       SELECT model, 0 AS point_idx, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS prec, is_binary, auc
         FROM r WHERE rk = 1 AND NOT is_binary
       UNION ALL SELECT model, 2 * rk - 1, rec_before, prec, is_binary, auc FROM r WHERE NOT is_binary
       UNION ALL SELECT model, 2 * rk, rec, prec, is_binary, auc FROM r WHERE NOT is_binary
       UNION ALL SELECT model, 0, rec, prec, is_binary, auc FROM r WHERE is_binary AND rk = 1)
SELECT model, point_idx, round(recall, 6) AS recall, round(prec, 6) AS "precision", is_binary, round(auc, 6) AS auc FROM steps"""


def _rounded(df):
    digits = {"precision", "recall", "threshold", "auc"}
    return df.select(*(F.round(c, 6).alias(c) if c in digits else c for c in df.columns))


def _documents(t):
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")


def _lines(t):
    return t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("returned"), *_LINE_SCORES)


@query("pr_curve", _points_sql(_DOCS.format(score="n_chars"), binary_as_point=True))
def pr_curve(t):
    return _rounded(curves.get_prc_curve_df(_documents(t), "quality", "n_chars"))


@query("pr_curve_multi", _points_sql(_DOCS.format(score="n_chars"), _DOCS.format(score="toxic"), binary_as_point=False))
def pr_curve_multi(t):
    return _rounded(curves.get_prc_curve_df(_documents(t), "quality", ["n_chars", "toxic"], binary_as_point=False))


@query("pr_curve_binary", _points_sql(_DOCS.format(score="n_chars"), _DOCS.format(score="toxic"), binary_as_point=True))
def pr_curve_binary(t):
    return _rounded(curves.get_prc_curve_df(_documents(t), "quality", ["n_chars", "toxic"]))


@query("pr_curve_lines", _points_sql(*(_LINES.format(score=s) for s in _LINE_SCORES), binary_as_point=True))
def pr_curve_lines(t):
    """Three models on the largest table."""
    return _rounded(curves.get_prc_curve_df(_lines(t), "returned", _LINE_SCORES))


@query("pr_curve_sliced", _points_sql(*(_LINES.format(score=s) for s in _LINE_SCORES), binary_as_point=True))
def pr_curve_sliced(t):
    """The same from a long table of scores."""
    scores = curves.scores_long(_lines(t), "returned", _LINE_SCORES)
    return _rounded(curves.prc_curve(scores))


@query("pr_step_curve", _steps_sql(_DOCS.format(score="n_chars"), binary_as_point=True))
def pr_step_curve(t):
    return _rounded(curves.get_prc_step_curve_df(_documents(t), "quality", "n_chars"))


@query("pr_step_curve_multi", _steps_sql(_DOCS.format(score="n_chars"), _DOCS.format(score="toxic"), binary_as_point=True))
def pr_step_curve_multi(t):
    return _rounded(curves.get_prc_step_curve_df(_documents(t), "quality", ["n_chars", "toxic"]))


@query("pr_step_points", _steps_sql(*(_LINES.format(score=s) for s in _LINE_SCORES), binary_as_point=False)
       .replace("SELECT model, point_idx, round(recall, 6) AS recall, round(prec, 6) AS \"precision\", is_binary, "
                "round(auc, 6) AS auc FROM steps",
                "SELECT model, point_idx - 2 AS point_idx, round(recall, 6) AS recall, round(prec, 6) AS \"precision\" "
                "FROM steps WHERE point_idx >= 2"))
def pr_step_points(t):
    """Step expansion of a curve that is a table already (it starts at its first threshold)."""
    curve = curves.get_prc_curve_df(_lines(t), "returned", _LINE_SCORES, binary_as_point=False)
    return _rounded(curves.step_points(curve))


@query("average_precision", _counted(*(_LINES.format(score=s) for s in _LINE_SCORES))
       + "SELECT model, round(auc, 6) AS auc FROM auc")
def average_precision(t):
    return _rounded(curves.average_precision(curves.scores_long(_lines(t), "returned", _LINE_SCORES)))


# Models by line status, one of them null; SQL joins on a stand-in for it.
_STATUS = """SELECT (l_returnflag = 'R')::INT AS y, l_extendedprice::DOUBLE AS score,
  CASE WHEN l_linestatus = 'F' THEN '~' ELSE l_linestatus END AS model FROM lineitem"""
_NULL_MODELS = ("SELECT * REPLACE (nullif(model, '~') AS model) FROM (" + _points_sql(_STATUS, binary_as_point=True) + ")")


def _null_model_scores(t):
    return t("lineitem").select(
        F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("model"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), F.col("l_extendedprice").alias("y_pred"))


@query("pr_curve_null_model", _NULL_MODELS)
def pr_curve_null_model(t):
    """A null model is a model like any other."""
    return _rounded(curves.prc_curve(_null_model_scores(t)))


@query("pr_curve_null_model_sliced", _NULL_MODELS)
def pr_curve_null_model_sliced(t):
    """The same behind a shuffle, by model and score: by the model alone, two tasks would hold all rows."""
    parts = shuffle_partitions(t.spark)
    return _rounded(curves.prc_curve(_null_model_scores(t).repartition(parts, "model", "y_pred")))


@query("pr_step_points_null_model", "SELECT * REPLACE (nullif(model, '~') AS model) FROM ("
       + _steps_sql(_STATUS, binary_as_point=False)
       .replace("SELECT model, point_idx, round(recall, 6) AS recall, round(prec, 6) AS \"precision\", is_binary, "
                "round(auc, 6) AS auc FROM steps",
                "SELECT model, point_idx - 2 AS point_idx, round(recall, 6) AS recall, round(prec, 6) AS \"precision\" "
                "FROM steps WHERE point_idx >= 2") + ")")
def pr_step_points_null_model(t):
    return _rounded(curves.step_points(curves.prc_curve(_null_model_scores(t), binary_as_point=False)))
