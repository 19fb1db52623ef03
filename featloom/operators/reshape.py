"""Reshaping nested tables: zip-explode, rename, flatten, melt, recode, preview."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named_col, normalise_name, quoted, require_distinct
from ..functions.nested import rename_values

# Largest dictionary turned into a map literal, which is searched entry by entry.
MAX_LITERAL_ENTRIES = 256


def head(df: DataFrame, nrows: int = 5) -> DataFrame:
    """The first ``nrows`` rows; order the frame first if it matters which."""
    return df.limit(nrows)


def display_head(df: DataFrame, nrows: int = 5) -> pd.DataFrame:
    """:func:`head` as pandas."""
    return head(df, nrows).toPandas()


displayHead = display_head  # noqa: N816


def zip_explode_cols(df: DataFrame, cols: Sequence[str], result_name: str,
                     rename_fields: Mapping[str, str] | None = None, *,
                     drop_sources: bool = False, outer: bool = False, strict: bool = False) -> DataFrame:
    """One row per array position, with the elements of ``cols`` packed in a struct.

    Arrays of uneven length are padded with null, or fail the query if ``strict``. Rows
    whose arrays are null or empty vanish, or keep one row with a null struct if
    ``outer``. The source arrays stay unless ``drop_sources``.
    """
    cols = list(cols)
    rename_fields = rename_fields or {}
    zipped = F.arrays_zip(*map(named_col, cols))
    if strict:
        sizes = [F.coalesce(F.size(named_col(c)), F.lit(-1)) for c in cols]
        uneven = F.greatest(*sizes) != F.least(*sizes) if len(cols) > 1 else F.lit(False)
        zipped = F.when(uneven, F.raise_error(F.lit(f"arrays of unequal length in {cols}"))).otherwise(zipped)
    element = T.StructType([
        T.StructField(rename_fields.get(c, c), df.schema[c].dataType.elementType) for c in cols])
    packed = zipped.cast(T.ArrayType(element))
    explode = F.explode_outer if outer else F.explode
    kept = [c for c in df.columns if c != result_name and not (drop_sources and c in cols)]
    return df.select(*map(named_col, kept), explode(packed).alias(result_name))


def rename_nested_fields(dtype: T.DataType, normaliser: Callable[[str], str]) -> T.DataType:
    """The same type with every struct field renamed, inside arrays and maps too."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(rename_nested_fields(dtype.elementType, normaliser), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(rename_nested_fields(dtype.keyType, normaliser),
                         rename_nested_fields(dtype.valueType, normaliser), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([
            T.StructField(normaliser(f.name), rename_nested_fields(f.dataType, normaliser), f.nullable)
            for f in dtype.fields])
    return dtype


def _struct_levels(dtype: T.DataType) -> Iterable[T.StructType]:
    if isinstance(dtype, T.StructType):
        yield dtype
        for f in dtype.fields:
            yield from _struct_levels(f.dataType)
    elif isinstance(dtype, T.ArrayType):
        yield from _struct_levels(dtype.elementType)
    elif isinstance(dtype, T.MapType):
        yield from _struct_levels(dtype.keyType)
        yield from _struct_levels(dtype.valueType)


def normalise_fields_names(df: DataFrame, fieldname_normaliser: Callable[[str], str] = normalise_name) -> DataFrame:
    """Rename every field at every depth in one projection."""
    renamed = rename_nested_fields(df.schema, fieldname_normaliser)
    for level in _struct_levels(renamed):
        require_distinct(df.sparkSession, level.names, "name normalisation")
    return df.select([
        (named_col(old.name) if old.dataType == new.dataType else named_col(old.name).cast(new.dataType))
        .alias(new.name) for old, new in zip(df.schema.fields, renamed.fields)])


# A leaf path is a tuple of steps: a field name, or EACH for the elements of an array.
EACH = None


def leaf_paths(dtype: T.DataType) -> list[tuple]:
    """Paths to all leaves of a type.

    Maps, and arrays with no struct below them, are leaves.
    """
    if isinstance(dtype, T.StructType):
        return [(f.name, *rest) for f in dtype.fields for rest in leaf_paths(f.dataType)]
    if isinstance(dtype, T.ArrayType):
        inner = leaf_paths(dtype.elementType)
        if any(step is not EACH for path in inner for step in path):
            return [(EACH, *path) for path in inner]
        return [()] if inner else []
    return [()]


def _path_alias(path: tuple) -> str:
    segments = [[]]
    for step in path:
        if step is EACH:
            segments.append([])
        else:
            segments[-1].append(step)
    return "_".join(".".join(segment) for segment in segments)


def _path_column(path: tuple) -> Column:
    column, depth = named_col(path[0]), 0
    for step in path[1:]:
        if step is EACH:
            depth += 1
        else:
            column = _field_at_depth(column, step, depth)
    return column


def _field_at_depth(column: Column, name: str, depth: int) -> Column:
    # Field access works through one array level by itself (and prunes the scan).
    if depth <= 1:
        return column.getField(name)
    return F.transform(column, lambda inner: _field_at_depth(inner, name, depth - 1))


def flatten(df: DataFrame, fieldname_normaliser: Callable[[str], str] = normalise_name) -> DataFrame:
    """One column per leaf of the schema.

    A leaf below an array of structs becomes an array. In the names, struct steps are
    joined by ``.`` and array steps by ``_``, then normalised.
    """
    paths = leaf_paths(df.schema)
    names = [fieldname_normaliser(_path_alias(path)) for path in paths]
    require_distinct(df.sparkSession, names, "flatten")
    return df.select([_path_column(path).alias(name) for path, name in zip(paths, names)])


def melt(df: DataFrame, id_vars: Iterable[str], value_vars: Iterable[str],
         var_name: str = "variable", value_name: str = "value", cast_to: str | T.DataType | None = None) -> DataFrame:
    """Wide to long: one row per input row and value column, nulls kept.

    ``cast_to`` brings value columns without a common type to one.
    """
    id_vars, value_vars = list(id_vars), list(value_vars)
    if cast_to is not None:
        df = df.select(*map(named_col, id_vars),
                       *(named_col(c).cast(cast_to).alias(c) for c in value_vars if c not in id_vars))
    return df.unpivot([named_col(c) for c in id_vars], [named_col(c) for c in value_vars], var_name, value_name)


def rename_column_values(df: DataFrame, column: str, map_dict: Mapping, default=None,
                         result: str | None = None) -> DataFrame:
    """:func:`rename_values` on one column, for dictionaries of any size.

    A short dictionary becomes a map literal; a long one a lookup table that is joined,
    and broadcast by Spark if its size allows. Both have the types of the map literal.
    """
    result = result or column
    if len(map_dict) <= MAX_LITERAL_ENTRIES:
        return df.withColumn(result, rename_values(named_col(column), map_dict, default))
    lookup = _lookup_table(df.sparkSession, map_dict)
    fallback = default if isinstance(default, Column) else F.lit(default)
    found = F.col("__new") if default is None else F.when(
        F.col("__old").isNull(), fallback).otherwise(F.coalesce("__new", fallback))
    joined = df.join(lookup, named_col(column) == F.col("__old"), "left")
    kept = [found.alias(c) if c == result else named_col(c) for c in df.columns]
    if result not in df.columns:
        kept.append(found.alias(result))
    return joined.select(*kept)


def _lookup_table(spark, map_dict: Mapping) -> DataFrame:
    """The entries as ``__old, __new``, of the types that a map literal of all of them has.

    Entries are grouped by the types of their literals; each group is a table of its own types, and the map
    of one entry of each group tells the common ones.
    """
    def kind(value):
        if isinstance(value, bool) or not isinstance(value, int):
            return type(value), str(value.as_tuple()[1:]) if isinstance(value, Decimal) else ""
        return int, "int" if -(1 << 31) <= value < 1 << 31 else "bigint"

    groups: dict[tuple, list] = {}
    for old, new in map_dict.items():
        groups.setdefault((kind(old), kind(new)), []).append((old, new))
    firsts = [F.lit(item) for entries in groups.values() for item in entries[0]]
    common = spark.range(1).select(F.create_map(*firsts).alias("m")).schema["m"].dataType
    tables = []
    for entries in groups.values():
        own = spark.range(1).select(*(F.lit(item).alias(name) for item, name in zip(entries[0], ("__old", "__new")))).schema
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in own])
        tables.append(spark.createDataFrame(entries, schema).select(
            F.col("__old").cast(common.keyType).alias("__old"), F.col("__new").cast(common.valueType).alias("__new")))
    return reduce(DataFrame.union, tables)
