"""Equi-joins that stay balanced when single keys hold a large share of the rows.

Spark's adaptive execution splits skewed inner and one-sided outer joins, but never a
full outer join, nor the optional side of a left join. Here the hot keys of all sides that meet on a key
are found first, by one job: a mergeable frequency sketch of each side's keys. A key travels through the sketch as
a string that gives its exact value back. Which keys are treated as hot affects
only the speed: every key of the table does exist in its side, and that is all the join relies on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import named_col
from .storage import checkpointed, known_unique, recomputed_cheaply, shuffle_partitions

# A key with more rows than this on one side is worth splitting.
HOT_ROWS = 1_000_000
# Keys that a sketch keeps track of. A key with more than about 3.5 / TRACKED of all rows is always found.
TRACKED = 10_000
# Longest key, as a string, that is tracked; together they bound the bytes of a sketch.
LONGEST = 256
# Bound on the hot keys kept per side, and with it on what is broadcast.
MAX_HOT_KEYS = 1_000
MAX_PARTS = 4_096

_SPREAD = "__spread"
_SALTS = ("__salt_left", "__salt_right")
_PARTS = ("__parts_left", "__parts_right")


@dataclass(frozen=True)
class SkewPolicy:
    """From how many rows on a key is hot, the share of rows that is looked at to find such keys, and how many are tracked."""

    hot_rows: int = HOT_ROWS
    sample: float = 1.0
    tracked: int = TRACKED


DEFAULT_POLICY = SkewPolicy()


@dataclass
class HotKeys:
    """Hot keys of one join side: a table of keys with ``__parts``, and whether null keys are hot."""

    table: DataFrame | None = None
    nulls: bool = False

    def merge(self, other: "HotKeys") -> "HotKeys":
        nulls = self.nulls or other.nulls
        if self.table is None or other.table is None:
            return HotKeys(self.table if other.table is None else other.table, nulls)
        keys = [c for c in self.table.columns if c != "__parts"]
        both = self.table.unionByName(other.table).groupBy(*map(named_col, keys)).agg(F.max("__parts").alias("__parts"))
        return HotKeys(both.orderBy(F.desc("__parts")).limit(MAX_HOT_KEYS), nulls)

    def __bool__(self) -> bool:
        return self.table is not None or self.nulls


# Types whose values a string gives back exactly, with the way there and the way back. No such string holds a comma.
_AS_TEXT = {
    T.StringType: (lambda c: F.base64(c.cast("binary")), lambda s: F.unbase64(s).cast("string")),
    T.BinaryType: (F.base64, F.unbase64),
    T.DateType: (lambda c: F.unix_date(c).cast("string"), lambda s: F.date_from_unix_date(s.cast("int"))),
    T.TimestampType: (lambda c: F.unix_micros(c).cast("string"), lambda s: F.timestamp_micros(s.cast("long"))),
    # minus zero equals zero, and joins treat them so
    T.DoubleType: (lambda c: (c + F.lit(0.0)).cast("string"), lambda s: s.cast("double")),
    T.FloatType: (lambda c: (c + F.lit(0.0).cast("float")).cast("string"), lambda s: s.cast("float")),
} | {kind: (lambda c: c.cast("string"), None) for kind in (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.TimestampNTZType)}


def _searchable(field: T.StructField) -> bool:
    kind = type(field.dataType)
    return kind in _AS_TEXT and (kind is not T.StringType or field.dataType.simpleString() == "string")


def _key_text(df: DataFrame, on: Sequence[str]) -> Column:
    """The key as one string; null if any part is."""
    parts = [_AS_TEXT[type(df.schema[c].dataType)][0](named_col(c)) for c in on]
    joined = F.concat(*[p for k, part in enumerate(parts) for p in ([F.lit(",")] if k else []) + [part]])
    return joined if len(parts) > 1 else parts[0]


def _key_values(df: DataFrame, on: Sequence[str], text: Column) -> list[Column]:
    """The key columns that a string stands for."""
    pieces, out = F.split(text, ",", -1), []
    for k, name in enumerate(on):
        kind = df.schema[name].dataType
        back = _AS_TEXT[type(kind)][1] or (lambda s, kind=kind: s.cast(kind))
        out.append(back(pieces[k]).alias(name))
    return out


def may_repeat(df: DataFrame, on: Sequence[str], policy: SkewPolicy | None) -> bool:
    """Whether hot keys of ``df`` are searched: its keys have types that can be, and Catalyst does not know them to be unique."""
    return policy is not None and all(_searchable(df.schema[c]) for c in on) and not known_unique(df, on)


def hot_keys_of(sides: Sequence[DataFrame], on: Sequence[str], policy: SkewPolicy | None = DEFAULT_POLICY) -> list[HotKeys]:
    """For each side its keys with more than ``policy.hot_rows`` rows, in one job for all of them.

    Each task sketches the key columns of its rows, side by side, and hands on one sketch a side; the merged sketches name at most
    ``MAX_HOT_KEYS`` keys each, which come to the driver as strings of bounded length. A side is read through its lineage; a
    caller that reads it again should hand over a stored one (:func:`stored_if_derived`).
    """
    out = [HotKeys() for _ in sides]
    asked = [k for k, df in enumerate(sides) if may_repeat(df, on, policy)]
    if not asked:
        return out
    keys = [sides[k].select(F.lit(k).alias("side"), _key_text(sides[k], on).alias("key")) for k in asked]
    if policy.sample < 1:
        keys = [df.sample(policy.sample, seed=17) for df in keys]
    least = policy.hot_rows * policy.sample
    tracked = F.when(F.length("key") <= LONGEST, F.col("key"))
    sketched = (reduce(DataFrame.union, keys).select("side", "key", tracked.alias("tracked")).groupBy("side")
                .agg(F.expr(f"approx_top_k_accumulate(tracked, {policy.tracked}) FILTER (WHERE tracked IS NOT NULL)").alias("sketch"),
                     F.count_if(F.col("key").isNull()).alias("nulls"), F.count_if(F.col("tracked").isNotNull()).alias("keys")))
    found = sketched.select("side", "nulls", F.when(F.col("keys") > least, F.filter(
        F.expr(f"approx_top_k_estimate(sketch, {MAX_HOT_KEYS})"), lambda x: x["count"] > F.lit(least))).alias("top"))
    for row in found.collect():  # a row a side
        df, top = sides[row.side], row.top or []
        table = None
        if top:
            parts = [(x["item"], min(max(math.ceil(x["count"] / max(least, 1)), 2), MAX_PARTS)) for x in top]
            table = df.sparkSession.createDataFrame(parts, "key string, __parts int")
            table = table.select(*_key_values(df, on, F.col("key")), "__parts")
        out[row.side] = HotKeys(table, row.nulls > least)
    return out


def find_hot_keys(df: DataFrame, on: Sequence[str], policy: SkewPolicy | None = DEFAULT_POLICY) -> HotKeys:
    """:func:`hot_keys_of` for one side."""
    return hot_keys_of([df], on, policy)[0]


def stored_if_derived(df: DataFrame, on: Sequence[str], policy: SkewPolicy | None) -> DataFrame:
    """``df``, or a checkpoint of it if the search for its hot keys would compute what stands before a shuffle, a join or Python twice.

    So planning and running a join pull every row of a derived side through its lineage once.
    """
    return checkpointed(df) if may_repeat(df, on, policy) and not recomputed_cheaply(df) else df


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
               hot_left: HotKeys | None = None, hot_right: HotKeys | None = None,
               spread_nulls: bool = False) -> DataFrame:
    """``left.join(right, on, how)`` with the rows of hot keys spread over many tasks.

    A hot key's rows on one side are dealt out to numbered parts, and the matching rows
    of the other side are copied to each part, so every pair meets exactly once. A copy
    that finds no partner in its part is dropped: the key is known to exist over there,
    so its row was matched in another part. Null keys match nothing; they are just
    spread out. Without hot keys this is the plain join.
    """
    on = list(on)
    hot_left, hot_right = hot_left or HotKeys(), hot_right or HotKeys()
    if how in ("left_semi", "left_anti"):
        # one row per key is all that matters on the right
        right, hot_right = right.select(*map(named_col, on)).distinct(), HotKeys()
    if not (hot_left or hot_right or spread_nulls):
        return left.join(right, on=on, how=how)

    left_out, right_out = _unique_columns(left, right, on, how)
    hot_keys = _both_parts(on, hot_left.table, hot_right.table)
    salted_left = _salted(left, on, hot_keys, own=0, hot=hot_left, mark="__in_left")
    salted_right = _salted(right, on, hot_keys, own=1, hot=hot_right, mark="__in_right")
    joined = salted_left.join(salted_right, on=on + list(_SALTS), how=how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*map(named_col, on), *left_out)
    if hot_keys is not None and how in ("left", "full", "right"):
        stray_left = F.col("__in_right").isNull() & F.coalesce("__in_left", F.lit(False))
        stray_right = F.col("__in_left").isNull() & F.coalesce("__in_right", F.lit(False))
        joined = joined.where(~stray_left & ~stray_right)
    return joined.select(*map(named_col, on), *left_out, *right_out)


def _both_parts(on: list[str], left: DataFrame | None, right: DataFrame | None) -> DataFrame | None:
    """One row per key that is hot on either side, with the parts of both; at most 2 * MAX_HOT_KEYS rows.

    The union brings the keys to the types that the join itself would bring both sides to.
    """
    tables = [table.select(*map(named_col, on), *(F.col("__parts").alias(p) if p == own else F.lit(1).alias(p) for p in _PARTS))
              for table, own in zip((left, right), _PARTS) if table is not None]
    if not tables:
        return None
    return (reduce(DataFrame.union, tables).groupBy(*map(named_col, on))
            .agg(*(F.max(p).alias(p) for p in _PARTS)))


def _unique_columns(left, right, on, how) -> tuple[list[Column], list[Column]]:
    mine = [c for c in left.columns if c not in on]
    theirs = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    clash = set(mine) & set(theirs)
    if clash:
        raise ValueError(f"both join sides have the columns {sorted(clash)}")
    return [named_col(c) for c in mine], [named_col(c) for c in theirs]


def _salted(df: DataFrame, on: list[str], hot_keys: DataFrame | None, own: int, hot: HotKeys, mark: str) -> DataFrame:
    """``df`` with both salt columns; rows copied where the other side has parts.

    ``mark`` is never null, and true for rows that were copied.
    """
    columns = list(df.columns)
    if hot:
        df = _dealt_out(df)
    else:
        hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        df = df.withColumn(_SPREAD, F.xxhash64(*map(named_col, hashable)))
    null_key = F.lit(False)
    for name in on:
        null_key = null_key | named_col(name).isNull()

    if hot_keys is None:
        my_parts = their_parts = F.lit(1)
    else:
        df = df.join(F.broadcast(hot_keys), on=on, how="left")  # at most 2 * MAX_HOT_KEYS rows
        my_parts, their_parts = (F.coalesce(_PARTS[side], F.lit(1)) for side in (own, 1 - own))
    my_salt = F.when(null_key, F.pmod(_SPREAD, F.lit(MAX_PARTS))).otherwise(F.pmod(_SPREAD, my_parts)).cast("int")
    their_salt = F.lit(0) if hot_keys is None else F.explode(F.sequence(F.lit(0), their_parts - 1))
    return df.select(*map(named_col, columns), my_salt.alias(_SALTS[own]), (their_parts > 1).alias(mark),
                     their_salt.alias(_SALTS[1 - own]))


def _dealt_out(df: DataFrame) -> DataFrame:
    """``df`` with a number in ``__spread`` that differs even between equal rows.

    A retried task must give its rows the same numbers. Scans and projections repeat the
    order of their rows; behind a shuffle the order may differ, so there the rows are dealt
    out round-robin, which Spark makes repeatable by sorting each partition first.
    """
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
        return df.withColumn(_SPREAD, F.monotonically_increasing_id())
    return df.repartition(shuffle_partitions(df.sparkSession)).withColumn(_SPREAD, F.spark_partition_id())


def with_all_values(df: DataFrame, values: DataFrame, block: int = 1_000) -> DataFrame:
    """Every row of ``df`` once per row of ``values``, in one lazy plan whatever the count of values.

    The values are packed to numbered arrays of ``block`` at most. Every row of ``df`` gets all numbers, meets the arrays by
    them in an equi-join (which Spark makes a broadcast join while the arrays are small, so that no row moves), and its array is unpacked. The
    numbers are a value of the plan, one in ``block`` values. No value leaves Spark.
    """
    names = values.columns
    kept = [named_col(c) for c in df.columns]
    # Hashed to buckets first, so that no task numbers all values; equal values may change places without harm.
    bucket = F.pmod(F.xxhash64(*map(named_col, names)), F.lit(shuffle_partitions(df.sparkSession))).alias("__bucket")
    within = Window.partitionBy("__bucket").orderBy(*map(named_col, names))
    packed = (values.select(bucket, *map(named_col, names))
              .withColumn("__slice", F.floor((F.row_number().over(within) - 1) / block))
              .groupBy("__bucket", "__slice").agg(F.collect_list(F.struct(*map(named_col, names))).alias("__values"))
              .select(F.struct("__bucket", "__slice").alias("__block"), "__values"))
    numbers = packed.agg(F.collect_list("__block").alias("__blocks")).scalar()
    met = df.select(*kept, F.explode(numbers).alias("__block")).join(packed, "__block").select(*kept, F.explode("__values").alias("__value"))
    return met.select(*kept, *(F.col("__value").getField(n).alias(n) for n in names))
