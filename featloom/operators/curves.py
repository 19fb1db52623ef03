"""Precision-recall curves and average precision, for many models in one job.

Scores come as a long table: one row per model and example. Equal scores of a model are
one threshold, so the first aggregation shrinks the data to the distinct scores; counts
above each threshold are running totals over those.

Conventions: every distinct score is a threshold; the positive label is 1 (or true);
without positives recall is 1, and 0 for a binary predictor, while precision and average
precision are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named_col
from ..plans.ordered import DIGIT, GROUP, running_totals


def scores_long(df: DataFrame, y_trues: str | Sequence[str], y_preds: str | Sequence[str],
                labels: Sequence | None = None) -> DataFrame:
    """Wide score columns to long ``model, y_true, y_pred``.

    One truth column serves all models. Labels default to the score column names.
    """
    y_preds = [y_preds] if isinstance(y_preds, str) else list(y_preds)
    y_trues = [y_trues] * len(y_preds) if isinstance(y_trues, str) else list(y_trues)
    labels = y_preds if labels is None else list(labels)
    if not len(y_trues) == len(y_preds) == len(labels):
        raise ValueError("need one truth column and one label per score column")
    rows = [F.struct(F.lit(label).alias("model"), named_col(truth).cast("double").alias("y_true"),
                     named_col(score).cast("double").alias("y_pred"))
            for label, truth, score in zip(labels, y_trues, y_preds)]
    return df.select(F.explode(F.array(*rows)).alias("s")).select("s.model", "s.y_true", "s.y_pred")


def _counted(scores: DataFrame) -> DataFrame:
    """Distinct scores with their counts, the running counts, rank and precision, and the positives, examples and thresholds of the model.

    Counts are doubles, exact up to 2^53. A faulty row counts as NaN, which spreads through all sums of its model, so that the query fails
    in its last stage (:func:`_checked`); three columns serve every part of the plan, and what they come from is computed once.
    """
    score, truth = (F.col(c).cast("double") for c in ("y_pred", "y_true"))
    fault, missing = F.lit(float("nan")), score.isNull() | F.isnan(score)
    # The model stands in a struct: scores that come partitioned by it are dealt anew, by score.
    points = (scores.select(F.struct("model").alias(GROUP), F.when(truth.isin(0.0, 1.0), truth).otherwise(fault).alias("positive"),
                            F.when(missing, F.lit(0.0)).otherwise(score).alias("threshold"), F.when(missing, fault).otherwise(F.lit(1.0)).alias("rows"))
              .groupBy(GROUP, "threshold").agg(F.sum("positive").alias("positive"), F.sum("rows").alias("rows"))
              .select(f"{GROUP}.model", "threshold", "positive", "rows"))
    return running_totals(
        points, ["model"], "threshold", {"true_positive": F.col("positive"), "predicted": F.col("rows"), "rank": F.lit(1)},
        {"positives": F.col("positive"), "examples": F.col("rows"), "thresholds": F.lit(1)}
    ).withColumn("precision", F.col("true_positive") / F.col("predicted"))


def _checked(df: DataFrame) -> DataFrame:
    """Fails when a row is asked for whose model has missing scores, which have no place in a curve, or other truths than 0 and 1."""
    def error(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("boolean")
    # a NaN among the counts makes the average precision one
    return df.where(F.when(~F.isnan("auc"), F.lit(True)).when(F.isnan("examples"), error("null or NaN in y_pred"))
                    .otherwise(error("y_true must be 0 or 1")))


def _curve(scores: DataFrame) -> DataFrame:
    """:func:`_counted` with recall, average precision, and the lowest and highest score of the model."""
    counted = _counted(scores)
    # A threshold's recall gain is its own positives over all positives. What holds for a model meets the thresholds by the first digit
    # of their scores: by the model alone, all of a model would meet in one task.
    every = Window.partitionBy(GROUP)
    models = counted.groupBy(GROUP, DIGIT).agg(
        F.min("threshold").alias("lowest"), F.max("threshold").alias("highest"), F.sum(F.col("positive") * F.col("precision")).alias("gains"))
    models = models.select(GROUP, DIGIT, F.min("lowest").over(every).alias("lowest"), F.max("highest").over(every).alias("highest"),
                           F.sum("gains").over(every).alias("gains"))
    curve = counted.join(models, [GROUP, DIGIT]).withColumn("auc", _auc(F.col("gains"), F.col("positives")))
    return _checked(curve).withColumn("recall", _recall(F.col("true_positive")))


def _auc(gains: Column, positives: Column) -> Column:
    return F.coalesce(F.try_divide(gains, positives), F.lit(0.0))


def _recall(true_positive: Column) -> Column:
    return F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(F.try_divide(true_positive, F.col("positives")))


def average_precision(scores: DataFrame) -> DataFrame:
    """``model, auc``: the sum over thresholds of recall gain times precision."""
    gains = F.sum(F.col("positive") * F.col("precision"))
    models = _counted(scores).groupBy("model").agg(
        _auc(gains, F.max("positives")).alias("auc"), F.max("examples").alias("examples"))
    return _checked(models).select("model", "auc")


def _as_points(curve: DataFrame) -> DataFrame:
    """A binary predictor's single point: predicted positive = the higher score."""
    binary = F.col("thresholds") <= 2
    return curve.where(~binary | (F.col("rank") == 1)).withColumns({
        "recall": F.when(binary & (F.col("positives") == 0), F.lit(0.0)).otherwise(F.col("recall")),
        # half the distance of the two scores, not their midpoint
        "threshold": F.when(binary, (F.col("highest") - F.col("lowest")) / 2).otherwise(F.col("threshold")),
        "thresholds": F.when(binary, F.lit(1)).otherwise(F.col("thresholds"))})


def prc_curve(scores: DataFrame, binary_as_point: bool = True) -> DataFrame:
    """Precision and recall at every threshold of every model.

    Columns ``model, point_idx, precision, recall, threshold, is_binary, auc``;
    ``point_idx`` counts from the highest threshold. The closing point (precision 1,
    recall 0) is left out. With ``binary_as_point`` a model with at most two distinct
    scores gives one point. The plan is lazy and the same for any number of rows.
    """
    curve = _curve(scores)
    if binary_as_point:
        curve = _as_points(curve)
    return curve.select("model", (F.col("rank") - 1).alias("point_idx"), "precision", "recall", "threshold",
                        (F.col("thresholds") == 1).alias("is_binary"), "auc")


def prc_step_curve(scores: DataFrame, binary_as_point: bool = True) -> DataFrame:
    """The curve as the corners of a step plot, from (recall 0, precision 1) on.

    Columns ``model, point_idx, recall, precision, is_binary, auc``, recall ascending.
    Between two points comes the corner with the recall of the first and the precision of
    the second.
    """
    curve = _curve(scores)
    single = F.lit(False)
    if binary_as_point:
        single = F.col("thresholds") <= 2
        curve = _as_points(curve.withColumn("single", single))
        single = F.col("single")

    def corner(idx: Column, recall: Column) -> Column:
        return F.struct(idx.cast("long").alias("point_idx"), recall.alias("recall"))

    rank = F.col("rank")
    first = rank == 1
    before = F.when(first, F.lit(0.0)).otherwise(_recall(F.col("true_positive") - F.col("positive")))
    steps = F.array(corner(2 * rank - 1, before), corner(2 * rank, F.col("recall")))
    start = F.array(corner(F.lit(0), F.lit(0.0)))
    corners = (F.when(single, F.array(corner(F.lit(0), F.col("recall"))))
               .when(first, F.concat(start, steps)).otherwise(steps))
    return (curve.select("model", "precision", "auc", single.alias("is_binary"), F.explode(corners).alias("c"))
            .select("model", "c.point_idx", "c.recall",
                    F.when((F.col("c.point_idx") == 0) & ~F.col("is_binary"), F.lit(1.0))
                    .otherwise(F.col("precision")).alias("precision"), "is_binary", "auc"))


def step_points(curve: DataFrame, group: Sequence[str] = ("model",), order: str = "point_idx") -> DataFrame:
    """Expand any curve of n points to its 2n-1 step corners.

    ``curve`` holds ``precision`` and ``recall``; ``order`` numbers the points 0..n-1 by
    ascending recall. A point's corner comes from the point before it, so each point is
    sent under its own number and under the next one, and the two meet in a grouping: the curve is
    computed once, and no window orders a whole group. Null is a group like any other. The points are dealt out
    by number before the grouping; grouping first would hold them in a hash table and merge nothing.
    """
    group = list(group)
    position = F.col(order).cast("long")
    own = F.struct(position.alias("at"), F.col("recall").alias("mine"), F.lit(None).cast("double").alias("before"),
                   F.col("precision").alias("precision"))
    later = F.struct((position + 1).alias("at"), F.lit(None).cast("double").alias("mine"), F.col("recall").alias("before"),
                     F.lit(None).cast("double").alias("precision"))
    sent = curve.select(*map(named_col, group), F.explode(F.array(own, later)).alias("p")).withColumn("at", F.col("p.at"))
    met = (sent.repartition(*map(named_col, group), "at")
           .groupBy(*map(named_col, group), "at")
           .agg(F.max("p.mine").alias("mine"), F.max("p.before").alias("before"), F.max("p.precision").alias("precision"))
           .where(F.col("mine").isNotNull()))
    corners = F.array(F.struct((2 * F.col("at") - 1).alias("idx"), F.col("before").alias("recall")),
                      F.struct((2 * F.col("at")).alias("idx"), F.col("mine").alias("recall")))
    return (met.select(*map(named_col, group), "precision", F.explode(corners).alias("c"))
            .where(F.col("c.idx") >= 0)
            .select(*map(named_col, group), F.col("c.idx").alias(order), "c.recall", "precision"))


def get_prc_curve_df(df: DataFrame, y_trues, y_preds, labels=None, binary_as_point: bool = True) -> DataFrame:
    """:func:`prc_curve` on wide score columns."""
    return prc_curve(scores_long(df, y_trues, y_preds, labels), binary_as_point)


def get_prc_step_curve_df(df: DataFrame, y_trues, y_preds, labels=None, binary_as_point: bool = True) -> DataFrame:
    """:func:`prc_step_curve` on wide score columns."""
    return prc_step_curve(scores_long(df, y_trues, y_preds, labels), binary_as_point)


def get_prc_curve_df_single(df: DataFrame, y_true: str, y_pred: str, binary_as_point: bool = True) -> DataFrame:
    """The curve of one score column, without the model column."""
    return get_prc_curve_df(df, y_true, y_pred, None, binary_as_point).drop("model")


def get_prc_step_curve_df_single(df: DataFrame, y_true: str, y_pred: str, binary_as_point: bool = True) -> DataFrame:
    """The step curve of one score column, without the model column."""
    return get_prc_step_curve_df(df, y_true, y_pred, None, binary_as_point).drop("model")


def get_prc_step_curve(df: DataFrame, y_true: str, y_pred: str, binary_as_point: bool = True) -> DataFrame:
    """Only the corners: ``point_idx, precision, recall``."""
    return get_prc_step_curve_df_single(df, y_true, y_pred, binary_as_point).select("point_idx", "precision", "recall")
