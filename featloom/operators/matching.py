"""Matching differently spelled names by their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import java_regex, named_col

# What is removed from a name before comparing, and its replacement.
NAME_SEPARATORS = r"\s|_|\(|\)|-"
NAME_REPLACEMENT = ""


def normal_form(col: Column | str, regex: str = NAME_SEPARATORS, replace: str = NAME_REPLACEMENT) -> Column:
    """Lower-cased, with every match of ``regex`` replaced."""
    column = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(column, java_regex(regex), replace))


def str_normalize(names: DataFrame, column: str = "name", regex: str = NAME_SEPARATORS,
                  replace: str = NAME_REPLACEMENT) -> DataFrame:
    """Distinct names by normal form: columns ``norm`` and ``name``. Nulls are left out.

    Two names with one normal form fail the query. Equal names collapse before anything is
    shuffled, so only distinct names are normalised and checked.
    """
    distinct = names.select(named_col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    formed = distinct.select("name", normal_form("name", regex, replace).alias("norm"))
    bounds = formed.groupBy("norm").agg(F.min("name").alias("__low"), F.max("name").alias("__high"))
    clash = F.concat(F.lit("non-unique names after normalisation: "), "__low", F.lit(" / "), "__high")
    return bounds.select("norm", F.when(F.col("__low") == F.col("__high"), F.col("__low"))
                         .otherwise(F.raise_error(clash)).alias("name"))


def fuzzy_match_names(names_a: DataFrame, names_b: DataFrame, column_a: str = "name", column_b: str = "name",
                      regex: str = NAME_SEPARATORS, replace: str = NAME_REPLACEMENT) -> DataFrame:
    """Pair the distinct names of two columns: ``norm, names_a, names_b``, null for no partner."""
    side_a = str_normalize(names_a, column_a, regex, replace).withColumnRenamed("name", "names_a")
    side_b = str_normalize(names_b, column_b, regex, replace).withColumnRenamed("name", "names_b")
    return side_a.join(side_b, on="norm", how="outer")


def fuzzy_match_to_reference(ref_names: DataFrame, alt_names: DataFrame, ref_column: str = "name",
                             alt_column: str = "name", result: str = "ref_name",
                             regex: str = NAME_SEPARATORS, replace: str = NAME_REPLACEMENT) -> DataFrame:
    """Add to every row of ``alt_names`` the reference spelling of its name, or null.

    Rows are kept as they are, repeated and null names included. A name repeated by a
    third of the rows is no problem: the lookup side has each name once, so Spark
    broadcasts it or splits the large side.
    """
    reference = str_normalize(ref_names, ref_column, regex, replace).withColumnRenamed("name", "__ref")
    # distinct spellings on this side must have distinct normal forms too
    spelled = str_normalize(alt_names, alt_column, regex, replace).withColumnRenamed("name", "__alt")
    lookup = spelled.join(reference, on="norm", how="left").select("__alt", "__ref")
    return (alt_names.join(lookup, named_col(alt_column) == F.col("__alt"), "left")
            .select(*map(named_col, alt_names.columns), F.col("__ref").alias(result)))
