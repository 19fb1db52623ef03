import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from featloom import join_featuresets, load_featuresets, transform_featureset
from featloom.plans.skew import SkewPolicy

from .conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_transform_names_and_index(spark):
    df = frame(spark, [(1, (5, (6.0,)))], "id int, s struct<a:int, `x.y`:struct<m:double>>")
    out = transform_featureset(df, "f", {"s": ["a", {"x.y": "m"}]}, ["id", "absent"])
    assert out.columns == ["id", "feature.f@s.a", "feature.f@s.x.y.m"] and rows(out) == [(1, 5, 6.0)]


def test_null_keys_do_not_meet(spark):
    left = frame(spark, [(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = frame(spark, [(1, "x"), (3, "y"), (None, "z")], "k int, v string")
    for unique in (False, True):
        out = join_featuresets({"l": left, "r": right}, {"l": ["v"], "r": ["v"]}, ["k"], unique_keys=unique)
        assert rows(out) == [(None, None, "z"), (None, "c", None), (1, "a", "x"), (2, "b", None), (3, None, "y")]


def test_key_set_chain(spark):
    g = frame(spark, [(1, "A")], "g int, v string")
    gt = frame(spark, [(1, "t1", "B"), (2, "t2", "B2")], "g int, t string, v string")
    t = frame(spark, [("t2", "C"), ("t3", "C3")], "t string, v string")
    out = join_featuresets({"a": g, "b": gt, "c": t}, {n: ["v"] for n in "abc"}, ["g", "t"])
    assert out.columns == ["g", "t", "feature.a@v", "feature.b@v", "feature.c@v"]
    assert rows(out) == [(None, "t3", None, None, "C3"), (1, "t1", "A", "B", None), (2, "t2", None, "B2", "C")]


def test_order_of_sets_matters(spark):
    """The chain is not associative: another order gives other rows."""
    sets = {"a": frame(spark, [(1, "A")], "g int, v string"),
            "c": frame(spark, [("t2", "C")], "t string, v string")}
    with pytest.raises(ValueError, match="share none"):
        join_featuresets(sets, {n: ["v"] for n in "ac"}, ["g", "t"])


def test_unique_keys_promise_is_checked(spark):
    left = frame(spark, [(1, "a"), (1, "b")], "k int, v string")
    right = frame(spark, [(1, "x")], "k int, v string")
    sets, spec = {"l": left, "r": right}, {"l": ["v"], "r": ["v"]}
    assert join_featuresets(sets, spec, ["k"]).count() == 2
    with pytest.raises(PySparkException, match="repeats a key"):
        join_featuresets(sets, spec, ["k"], unique_keys=True).collect()


def test_unique_keys_shuffle_once(spark, sf_dir):
    def sets():
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return {f"s{i}": orders.withColumnRenamed("o_orderkey", "k") for i in range(4)}
    spec = {f"s{i}": ["o_totalprice"] for i in range(4)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def exchanges(**options):
            plan = join_featuresets(sets(), spec, ["k"], **options)._jdf.queryExecution().executedPlan().toString()
            return plan.count("Exchange hashpartitioning")
        assert exchanges() == 6
        assert exchanges(unique_keys=True) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fill_null_and_nan(spark):
    df = frame(spark, [(1, float("nan"), None), (2, None, "s"), (3, 1.5, "t")], "k int, d double, s string")
    out = join_featuresets({"f": df}, {"f": ["d", "s"]}, ["k"], fill_values={"feature.f@d": 0, "feature.f@s": "-"})
    assert rows(out) == [(1, 0.0, "-"), (2, 0.0, "s"), (3, 1.5, "t")]
    assert out.schema["feature.f@d"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="not in the result"):
        join_featuresets({"f": df}, {"f": ["d"]}, ["k"], fill_values={"d": 0})


def test_missing_index_columns(spark):
    df = frame(spark, [(1, "a")], "k int, v string")
    assert join_featuresets({"f": df}, {"f": ["v"]}, ["k", "ghost"]).columns == ["k", "feature.f@v"]
    with pytest.raises(ValueError, match="ghost"):
        join_featuresets({"f": df}, {"f": ["v"]}, ["k", "ghost"], ignore_missing_columns=False)


def test_sets_without_index_column(spark):
    df, loose = frame(spark, [(1, "a")], "k int, v string"), frame(spark, [("z",)], "v string")
    spec = {"f": ["v"], "loose": ["v"]}
    with pytest.raises(ValueError, match="no index column"):
        join_featuresets({"f": df, "loose": loose}, spec, ["k"])
    out = join_featuresets({"f": df, "loose": loose}, spec, ["k"],
                           broadcast_columns={"k": frame(spark, [(1,), (2,)], "k int")})
    assert rows(out) == [(1, "a", "z"), (2, None, "z")]


@pytest.mark.parametrize("join, expected", [
    ("inner", [(1, "i1", "a", "x")]),
    ("left", [(1, "i1", "a", "x"), (9, "i9", None, None)]),
    ("right", [(1, "i1", "a", "x"), (2, None, "b", None)]),
    ("left_semi", [(1, "i1")]), ("left_anti", [(9, "i9")]),
    ("outer", [(1, "i1", "a", "x"), (2, None, "b", None), (9, "i9", None, None)])])
def test_join_types_onto_initial(spark, join, expected):
    initial = frame(spark, [(1, "i1"), (9, "i9")], "k int, i string")
    sets = {"l": frame(spark, [(1, "a"), (2, "b")], "k int, v string"), "r": frame(spark, [(1, "x")], "k int, v string")}
    out = join_featuresets(sets, {"l": ["v"], "r": ["v"]}, ["k"], join=join, initial_df=initial)
    assert rows(out) == sorted(expected, key=lambda r: r[0])


def test_other_join_without_initial(spark):
    sets = {"g": frame(spark, [(1, "a"), (2, "b")], "g int, v string"),
            "gt": frame(spark, [(1, "t", "x"), (3, "t", "y")], "g int, t string, v string")}
    out = join_featuresets(sets, {"g": ["v"], "gt": ["v"]}, ["g", "t"], join="inner")
    assert rows(out) == [(1, "t", "a", "x")]


def test_cross_join_type_is_refused(spark):
    with pytest.raises(ValueError, match="unsupported join type"):
        join_featuresets({"f": frame(spark, [(1,)], "k int")}, {"f": []}, ["k"], join="cross")


def test_broadcast_given_and_inferred(spark):
    g = frame(spark, [(1, "A"), (2, "B")], "g int, v string")
    gt = frame(spark, [(1, "t1", "C"), (3, "t2", "D")], "g int, t string, v string")
    args = ({"a": g, "b": gt}, {"a": ["v"], "b": ["v"]}, ["g", "t"])
    expected = [(1, "t1", "A", "C"), (1, "t2", "A", None), (2, "t1", "B", None), (2, "t2", "B", None),
                (3, "t2", None, "D")]
    values = frame(spark, [("t1",), ("t2",)], "t string")
    assert rows(join_featuresets(*args, broadcast_columns={"t": values})) == expected
    assert rows(join_featuresets(*args, broadcast_columns="infer")) == expected


def test_no_cross_product_in_broadcast_plan(spark):
    g = frame(spark, [(1, "A")], "g int, v string")
    gt = frame(spark, [(1, "t1", "C")], "g int, t string, v string")
    out = join_featuresets({"a": g, "b": gt}, {"a": ["v"], "b": ["v"]}, ["g", "t"], broadcast_columns="infer")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_parquet_scan_is_pruned(spark, sf_dir):
    out = load_featuresets(spark, {"d": f"{sf_dir}/documents.parquet"}, {"d": ["lang"]}, ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_nested_scan_is_pruned(spark, tmp_path):
    spark.range(3).select("id", F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")).alias("s")).write.parquet(
        str(tmp_path / "n"))
    out = load_featuresets(spark, {"n": str(tmp_path / "n")}, {"n": {"s": "a"}}, ["id"])
    assert "s:struct<a:int>>" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skew", [None, SkewPolicy(hot_rows=3)])
def test_spine_gives_the_rows_of_the_chain(spark, skew):
    """Repeated, missing and null keys, a hot key, and sets whose keys differ."""
    a = spark.createDataFrame([(1, f"a{i}") for i in range(9)] + [(2, "x"), (None, "n"), (None, "n")], "g int, a string")
    b = spark.createDataFrame([(1, "b1"), (1, "b2"), (3, "b3"), (None, "m")], "g int, b string")
    c = spark.createDataFrame([(2, "c"), (3, "c"), (4, "c")], "g int, c string")
    d = spark.createDataFrame([(1, "t", "d"), (5, "t", "d5"), (3, None, "d3"), (None, "u", "dn")], "g int, t string, d string")
    e = spark.createDataFrame([("t", 1), ("t", 2), ("w", 3), (None, 4)], "t string, e int")
    sets = {"a": a, "b": b, "c": c, "d": d, "e": e}
    args = (sets, {name: [name] for name in sets}, ["g", "t"])
    chain, spine = join_featuresets(*args, skew=None), join_featuresets(*args, spine=True, skew=skew)
    assert spine.columns == chain.columns and rows(spine) == rows(chain)
    initial = spark.createDataFrame([(1, "i"), (7, "i")], "g int, i string")
    for join in ("outer", "left", "right", "inner", "left_anti"):
        sets.pop("e", None)  # shares nothing with the initial table
        chain, spine = (join_featuresets(*args, initial_df=initial, join=join, spine=s, skew=None) for s in (False, True))
        assert rows(spine) == rows(chain)


def test_spine_saves_exchanges_and_passes_filters(spark, tmp_path):
    spark.range(100).selectExpr("id AS g", "id AS v").write.parquet(str(tmp_path / "t"))
    sets = {f"s{k}": spark.read.parquet(str(tmp_path / "t")) for k in range(5)}
    args = (sets, {name: ["v"] for name in sets}, ["g"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chain, spine = (join_featuresets(*args, spine=s, skew=None) for s in (False, True))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (chain, spine)]
        # 2 k - 2 and k + 1
        assert [plan.count("Exchange hashpartitioning") for plan in plans] == [8, 6]
        picked = spine.where("g = 5")._jdf.queryExecution().executedPlan().toString()
        assert picked.count("FileScan") == picked.count("EqualTo(g,5)") >= 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_keys_of_unique_sets_need_no_numbers(spark):
    """Equal rows with null keys stay apart, and nothing in the plan depends on the order of rows."""
    a = spark.createDataFrame([(None, "n")] * 3 + [(1, "x")], "g int, a string").repartition(3)
    b = spark.createDataFrame([(None, "m")] * 2 + [(1, "y"), (2, "z")], "g int, b string").repartition(2)
    out = join_featuresets({"a": a, "b": b}, {"a": ["a"], "b": ["b"]}, ["g"], unique_keys=True)
    assert rows(out) == rows(spark.createDataFrame([(None, "n", None)] * 3 + [(None, None, "m")] * 2 + [(1, "x", "y"), (2, None, "z")],
                                                   "g int, a string, b string"))
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
