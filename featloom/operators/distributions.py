"""Fitting, scoring and sampling one distribution per group."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named_col
from ..functions.negbin import Beta, NegativeBinomial, Normal, tail_pvalue
from ..functions.sampling import Stream
from ..plans.storage import shuffle_partitions

# Draws of a distribution that stay in one task; more of them are cut into such blocks.
BLOCK = 4_096


def nb_fit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Negative binomials by the method of moments, one row per group.

    Columns: the keys, ``n, mean, variance, r, p, overdispersed``. Where the variance does
    not exceed the mean, ``r`` and ``p`` are null. Null keys form a group of their own.
    """
    fitted = NegativeBinomial.mme(named_col(value))
    return df.groupBy(*map(named_col, keys)).agg(
        F.count(named_col(value)).alias("n"), fitted.mean.alias("mean"),
        F.var_pop(named_col(value).cast("double")).alias("variance"), fitted.r.alias("r"),
        fitted.p.alias("p"), fitted.overdispersed.alias("overdispersed"))


def nb_reparameterise(params: DataFrame, **given: str) -> DataFrame:
    """Add ``nb_mean, nb_r, nb_variance, nb_p, nb_log_p, nb_log_1p`` to a parameter table.

    ``given`` names the columns of one of ``r``/``variance`` and one of ``p``/``mean``.
    """
    dist = NegativeBinomial(**given)
    base = params.withColumns({"nb_mean": dist.mean, "nb_r": dist.r})
    dist = NegativeBinomial(mean="nb_mean", r="nb_r")
    return base.withColumns({"nb_variance": dist.variance, "nb_p": dist.p,
                             "nb_log_p": dist.log_p, "nb_log_1p": dist.log_1p})


def nb_score(df: DataFrame, params: DataFrame, keys: Sequence[str], value: str,
             alternative: str | None = None) -> DataFrame:
    """Add ``log_prob, prob, cdf, log_cdf, pval`` of ``value`` under its group's distribution.

    ``params`` has one row per group with ``mean`` and ``r``; rows of groups it lacks are
    dropped. A small parameter table is broadcast by Spark. Beyond that this is an inner
    join, whose hot groups adaptive execution splits; nothing after it shuffles.
    """
    joined = _with_params(df, params, keys)
    dist = NegativeBinomial(mean="__mean", r="__r")
    scored = joined.withColumns({"log_prob": dist.log_prob(named_col(value)),
                                 "__pair": dist.cdf_pair(named_col(value))})
    undefined = F.lit(None).cast("double")
    scored = scored.withColumns({"prob": F.exp("log_prob"),
                                 "cdf": F.nanvl(F.col("__pair.cdf"), undefined),
                                 "log_cdf": F.nanvl(F.col("__pair.log_cdf"), undefined)})
    scored = scored.withColumn("pval", tail_pvalue(F.col("cdf"), F.col("prob"), alternative))
    return scored.select(*map(named_col, df.columns), "log_prob", "prob", "cdf", "log_cdf", "pval")


def nb_apply(df: DataFrame, params: DataFrame, keys: Sequence[str], value: str, measure: str,
             result: str | None = None, alternative: str | None = None) -> DataFrame:
    """One method of :class:`NegativeBinomial` on ``value``, as column ``result``.

    ``measure`` is ``log_prob``, ``prob``, ``cdf``, ``log_cdf`` or ``pval``; ``alternative``
    applies to ``pval``.
    """
    if measure not in ("log_prob", "prob", "cdf", "log_cdf", "pval"):
        raise ValueError(f"unknown measure {measure!r}")
    scored = _with_params(df, params, keys)
    dist = NegativeBinomial(mean="__mean", r="__r")
    if measure == "pval":
        # columns of their own, so that the density is computed in one place
        scored = scored.withColumns({"__cdf": dist.cdf(named_col(value)), "__density": dist.prob(named_col(value))})
        column = tail_pvalue(F.col("__cdf"), F.col("__density"), alternative)
    else:
        column = getattr(dist, measure)(named_col(value))
    return scored.select(*map(named_col, df.columns), column.alias(result or measure))


def _with_params(df: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    table = params.select(*map(named_col, keys), F.col("mean").cast("double").alias("__mean"),
                          F.col("r").cast("double").alias("__r"))
    return df.join(table, on=list(keys), how="inner")


def _draws(params: DataFrame, keys: Sequence[str], size: int, seed: int, **parameters: Column) -> DataFrame:
    """One row per distribution and draw: keys, ``parameters``, ``draw`` from 0 and ``__seed``.

    The seed comes from the keys and the draw number only, so draws do not depend on how the
    table is partitioned. Many draws of few distributions are dealt out to tasks.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    blocks = max(math.ceil(size / BLOCK), 1)
    table = params.select(*map(named_col, keys), *(c.cast("double").alias(n) for n, c in parameters.items()))
    defined = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in parameters))
    out = table.where(defined).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:
        out = out.repartition(shuffle_partitions(params.sparkSession), *map(named_col, keys), F.col("__block"))
    first = F.col("__block").cast("long") * BLOCK
    out = out.withColumn("draw", F.explode(F.sequence(first, F.least(first + BLOCK, F.lit(size).cast("long")) - 1))).drop("__block")
    return out.withColumn("__seed", F.xxhash64(F.lit(seed), *map(named_col, keys), F.col("draw")))


def _nb_values(r: pd.Series, mean: pd.Series, seed: pd.Series) -> pd.Series:
    r, mean = r.to_numpy("float64"), mean.to_numpy("float64")
    stream = Stream(seed.to_numpy("int64"))
    return pd.Series(stream.poisson(stream.gamma(r) * (mean / r)))


def _beta_values(p: pd.Series, q: pd.Series, seed: pd.Series) -> pd.Series:
    stream = Stream(seed.to_numpy("int64"))
    return pd.Series(stream.beta(p.to_numpy("float64"), q.to_numpy("float64")))


def nb_sample(params: DataFrame, keys: Sequence[str], size: int = 1, seed: int = 0) -> DataFrame:
    """``keys, draw, value``: ``size`` draws from each negative binomial (columns ``mean, r``).

    A draw is a Poisson variable whose rate is a gamma variable, made for a whole Arrow batch at once. Groups with
    undefined parameters give no rows. Equal seeds give equal draws.
    """
    dist = NegativeBinomial(mean="mean", r="r")
    drawn = _draws(params, keys, size, seed, __r=dist.r, __mean=dist.mean).where("__r > 0 AND __mean > 0")
    return drawn.select(*map(named_col, keys), "draw", F.pandas_udf(_nb_values, "double")("__r", "__mean", "__seed").cast("long").alias("value"))


def beta_sample(params: DataFrame, keys: Sequence[str], size: int = 1, seed: int = 0,
                mean: str = "mean", samplesize: str = "samplesize") -> DataFrame:
    """``keys, draw, value``: draws from beta distributions given by mean and sample size."""
    dist = Beta(mean, samplesize)
    drawn = _draws(params, keys, size, seed, __p=dist.p, __q=dist.q).where("__p > 0 AND __q > 0")
    return drawn.select(*map(named_col, keys), "draw", F.pandas_udf(_beta_values, "double")("__p", "__q", "__seed").alias("value"))


def beta_params(params: DataFrame, mean: str = "mean", samplesize: str = "samplesize") -> DataFrame:
    """Add the shapes ``p`` and ``q`` of a beta distribution."""
    dist = Beta(mean, samplesize)
    return params.withColumns({"p": dist.p, "q": dist.q})


def normal_sample(params: DataFrame, keys: Sequence[str], size: int = 1, seed: int = 0,
                  mean: str = "mean", sd: str = "sd") -> DataFrame:
    """``keys, draw, value``: normal draws, by the Box-Muller formula on hashed uniforms.

    All of it is Column arithmetic; a draw depends on the seed, its keys and its number.
    """
    dist = Normal(mean, sd)
    draws = _draws(params, keys, size, seed, __mean=dist.mean, __sd=dist.sd)

    def uniform(stream: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.col("__seed"), F.lit(stream)), 11)
        return (bits + 1) / F.lit(float(2**53))  # in (0, 1]

    standard = F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * math.pi * uniform(2))
    return draws.select(*map(named_col, keys), "draw", (F.col("__mean") + F.col("__sd") * standard).alias("value"))
