"""Feature sets stored as parquet datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.featuresets import join_featuresets


def open_featuresets(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """One lazy frame per ``{name: path}``; only selected columns will be read."""
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def load_featuresets(spark: SparkSession, paths: Mapping[str, str], variables, index_cols, **options) -> DataFrame:
    """:func:`join_featuresets` on parquet paths."""
    return join_featuresets(open_featuresets(spark, paths), variables, index_cols, **options)
