"""Salted joins give exactly the rows of plain joins, whatever is hot."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from featloom.operators.featuresets import join_featuresets
from featloom.plans.skew import HotKeys, SkewPolicy, find_hot_keys, hot_keys_of, split_join, with_all_values
from featloom.plans.storage import known_unique

from .conftest import counting, rows

EAGER = SkewPolicy(hot_rows=5, sample=1.0)


def keys_of(hot):
    return {tuple(r)[:-1] for r in hot.table.collect()}


HOWS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


@pytest.fixture(scope="module")
def sides(spark):
    # key 1 hot on the left, 2 hot on the right, 3 hot on both, 4/5 unmatched and hot, null hot
    left = ([(1, "copy")] * 30 + [(2, "x"), (2, "y")] + [(3, f"l{i}") for i in range(12)]
            + [(4, f"only{i}") for i in range(20)] + [(None, "n")] * 15 + [(6, "one")])
    right = ([(1, "a"), (1, "b")] + [(2, f"r{i}") for i in range(25)] + [(3, f"r{i}") for i in range(9)]
             + [(5, "only")] * 11 + [(None, "m")] * 14 + [(6, "uno"), (7, "sette")])
    return (spark.createDataFrame(left, "k int, l string"), spark.createDataFrame(right, "k int, r string"))


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("shuffled", [False, True])
def test_split_join_equals_plain_join(sides, how, shuffled):
    left, right = (side.repartition(3, "k") for side in sides) if shuffled else sides
    hot_left, hot_right = (find_hot_keys(side, ["k"], EAGER) for side in sides)
    assert keys_of(hot_left) == {(1,), (3,), (4,)} and hot_left.nulls
    assert keys_of(hot_right) == {(2,), (3,), (5,)} and hot_right.nulls
    salted = split_join(left, right, ["k"], how, hot_left, hot_right)
    assert rows(salted) == rows(left.join(right, ["k"], how))


@pytest.mark.parametrize("how", ["left", "full"])
def test_spread_nulls_only(sides, how):
    left, right = sides
    assert rows(split_join(left, right, ["k"], how, spread_nulls=True)) == rows(left.join(right, ["k"], how))


def test_hot_rows_reach_many_tasks(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), F.lit("same").alias("l"))
    right = spark.createDataFrame([(1, "r")], "k int, r string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = split_join(left, right, ["k"], "full", HotKeys(spark.createDataFrame([(1, 16)], "k int, __parts int")))
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per_task) == 4000 and len(per_task) > 1 and max(per_task) < 4000


def test_rows_of_any_scan_are_searched(spark, tmp_path):
    local = spark.createDataFrame([(1, "a")] * 6, "k int, v string")
    assert not find_hot_keys(local, ["k"]) and not find_hot_keys(local.limit(0), ["k"])
    local.limit(1).write.parquet(str(tmp_path / "tiny"))
    tiny = spark.read.parquet(str(tmp_path / "tiny")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3_000_000))))
    assert keys_of(find_hot_keys(tiny, ["k"])) == {(1,)}


def test_planning_and_running_compute_derived_rows_once(sides, spark):
    """All sides of a join are searched by one job; what stands behind Python is stored first and read from there."""
    (left, seen_left), (right, seen_right) = (counting(side, spark) for side in sides)
    args = ({"l": left, "r": right}, {"l": ["l"], "r": ["r"]}, ["k"])
    plain = rows(join_featuresets(*({"l": sides[0], "r": sides[1]}, *args[1:]), skew=None))
    joined = join_featuresets(*args, skew=EAGER)
    assert rows(joined) == plain
    assert (seen_left.value, seen_right.value) == (sides[0].count(), sides[1].count())


def test_one_job_for_all_sides(sides, spark):
    group = "hot-key-search"
    spark.sparkContext.setJobGroup(group, "")
    try:
        hot = hot_keys_of(list(sides), ["k"], EAGER)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [keys_of(h) for h in hot] == [{(1,), (3,), (4,)}, {(2,), (3,), (5,)}] and all(h.nulls for h in hot)
    assert len(jobs) <= 2  # adaptive execution runs the stages of one query as jobs


KEY_VALUES = {
    "string": ["", "a,b", "é,", "a'\"\\", "x" * 100], "binary": [b"", b"a,b", b"\xff\x00"], "double": [0.1, -0.0, float("nan"), float("inf"), 1e300],
    "float": [0.5, -0.0, float("nan")], "boolean": [True, False], "bigint": [2**62, -5], "decimal(20,3)": [Decimal("1.500"), Decimal("-7.000")],
    "date": [datetime.date(1, 1, 1), datetime.date(2024, 2, 29)], "timestamp_ntz": [datetime.datetime(2024, 3, 10, 2, 30, 0, 123456)],
    "timestamp": [datetime.datetime(2024, 3, 10, 3, 30, 0, 123456)]}


@pytest.mark.parametrize("kind", KEY_VALUES)
def test_keys_pass_the_sketch_unchanged(spark, kind):
    values = KEY_VALUES[kind]
    df = spark.createDataFrame([(v, i) for v in values for i in range(9)], f"k {kind}, i int")
    hot = find_hot_keys(df, ["k", "i"], SkewPolicy(hot_rows=0))
    assert hot.table.count() == 9 * len(values) and hot.table.schema["k"].dataType == df.schema["k"].dataType
    single = find_hot_keys(df, ["k"], EAGER)
    assert single.table.count() == len(values) and single.table.join(df, "k").count() == 9 * len(values)


def test_long_keys_are_not_tracked(spark):
    df = spark.range(20).select(F.repeat(F.lit("x"), 10_000).alias("k"))
    assert not find_hot_keys(df, ["k"], EAGER)
    assert split_join(df, df.withColumn("r", F.lit(1)), ["k"], "full", find_hot_keys(df, ["k"], EAGER)).count() == 400


@pytest.mark.parametrize("how", HOWS)
def test_repeated_hour_of_summer_time(spark, how):
    """Two instants with the same local time are different keys, whatever is hot."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        left = spark.range(40).select(F.timestamp_seconds(F.lit(1793514600)).alias("k"), F.col("id").alias("l"))
        right = spark.range(3).select(F.timestamp_seconds(F.lit(1793511000)).alias("k"), F.col("id").alias("r"))
        hot = find_hot_keys(left, ["k"], SkewPolicy(hot_rows=10, sample=1.0))
        assert hot
        assert split_join(left, right, ["k"], how, hot).count() == left.join(right, ["k"], how).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("limit", [1, 1000])
def test_values_are_repeated_unchanged(spark, limit):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(2)
        values = spark.range(3).select(
            F.timestamp_seconds(F.lit(1793511000) + 3600 * F.col("id")).alias("at"),
            F.expr("CASE WHEN id < 2 THEN timestamp_ntz'2026-03-08 02:30:00' END").alias("ntz"),
            F.struct(F.col("id").alias("a"), F.lit("x").alias("b")).alias("s"))
        got = with_all_values(df, values, block=limit).selectExpr("id", "unix_seconds(at)", "string(ntz)", "s.a", "s.b")
        expected = [(i, 1793511000 + 3600 * k, "2026-03-08 02:30:00" if k < 2 else None, k, "x") for i in range(2) for k in range(3)]
        assert rows(got) == sorted(expected, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_grouped_frames_are_not_searched(sides):
    left = sides[0]
    grouped = left.groupBy("k", "l").count()
    assert not known_unique(left, ["k", "l"]) and not known_unique(grouped, ["k"])
    assert known_unique(grouped.select("l", "k"), ["k", "l"]) and known_unique(left.select("k").distinct(), ["k"])
    assert find_hot_keys(grouped.drop("count").union(left), ["k"], EAGER)
    assert not find_hot_keys(grouped, ["k", "l"], EAGER)


@pytest.mark.parametrize("kinds", [("int", "bigint"), ("bigint", "int"), ("binary", "binary"), ("date", "date")])
def test_other_key_types(sides, kinds):
    def typed(side, kind):
        key = F.date_add(F.lit("2020-01-01").cast("date"), "k") if kind == "date" else (
            F.col("k").cast("string").cast("binary") if kind == "binary" else F.col("k").cast(kind))
        return side.withColumn("k", key)
    left, right = (typed(side, kind) for side, kind in zip(sides, kinds))
    if kinds == ("bigint", "int"):
        left = left.union(left.sparkSession.createDataFrame([(1 << 40, "big")] * 9, left.schema))
    hot = [find_hot_keys(side, ["k"], EAGER) for side in (left, right)]
    assert all(hot)
    assert rows(split_join(left, right, ["k"], "full", *hot)) == rows(left.join(right, ["k"], "full"))


def test_two_column_keys(spark):
    left = spark.createDataFrame([(1, "a", i) for i in range(20)] + [(1, None, 99), (2, "b", 5)], "k int, g string, l int")
    right = spark.createDataFrame([(1, "a", 1), (1, None, 2), (3, "c", 3)], "k int, g string, r int")
    hot = find_hot_keys(left, ["k", "g"], EAGER)
    assert keys_of(hot) == {(1, "a")}
    assert rows(split_join(left, right, ["k", "g"], "full", hot)) == rows(left.join(right, ["k", "g"], "full"))


def test_right_joins_lose_no_hot_rows(sides, spark):
    """Key 4 is hot in the initial table, gone after the first right join, and back in the second set."""
    initial = sides[0]
    first = spark.createDataFrame([(1, "t", "f")], "k int, t string, v string")
    second = spark.createDataFrame([(4, "only here"), (1, "one")], "k int, v string")
    args = ({"f": first, "s": second}, {"f": ["v"], "s": ["v"]}, ["k", "t"])
    plain, salted = (join_featuresets(*args, join="right", initial_df=initial, skew=skew) for skew in (None, EAGER))
    assert rows(salted) == rows(plain) and (4, None, None, None, "only here") in rows(salted)


@pytest.mark.parametrize("join", ["outer", "left", "inner", "right", "left_anti"])
def test_featuresets_with_hot_keys(sides, spark, join):
    left, right = sides
    third = spark.createDataFrame([(k, t, f"v{k}{t}") for k in (1, 2, 8) for t in "xy"], "k int, t string, v string")
    initial = None if join in ("outer", "inner") else spark.createDataFrame([(1, "x"), (3, "y"), (9, None)], "k int, t string")
    args = ({"l": left, "r": right, "t": third}, {"l": ["l"], "r": ["r"], "t": ["v"]}, ["k", "t"])
    plain = join_featuresets(*args, join=join, initial_df=initial, skew=None)
    salted = join_featuresets(*args, join=join, initial_df=initial, skew=EAGER)
    assert salted.columns == plain.columns and rows(salted) == rows(plain)


@pytest.mark.parametrize("limit", [1000, 3])
def test_with_all_values_is_the_full_product(spark, limit):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int")
    values = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("z", 4), ("z", 4)], "b string, c int")
    got = with_all_values(left, values, block=limit)
    assert got.columns == ["a", "b", "c"] and rows(got) == rows(left.crossJoin(values))


def test_with_no_values(spark):
    assert with_all_values(spark.range(3), spark.createDataFrame([], "v string")).count() == 0
