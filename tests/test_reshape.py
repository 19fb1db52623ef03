import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import featloom as fl
from featloom.functions.names import decode_names, encode_names, quoted
from featloom.operators.reshape import leaf_paths

from .conftest import rows

ARRAYS = [(1, [1, 2], ["a"]), (2, [], []), (3, None, ["z"])]
ARRAYS_SCHEMA = "id int, a array<int>, b array<string>"


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame(ARRAYS, ARRAYS_SCHEMA)


def test_zip_explode_keeps_sources_and_pads(arrays):
    out = fl.zip_explode_cols(arrays, ["a", "b"], "z")
    assert out.columns == ["id", "a", "b", "z"]
    assert rows(out.select("id", "z.a", "z.b")) == [(1, 1, "a"), (1, 2, None)]


def test_zip_explode_outer_drop_rename(arrays):
    out = fl.zip_explode_cols(arrays, ["a", "b"], "z", {"b": "renamed"}, drop_sources=True, outer=True)
    assert out.columns == ["id", "z"]
    assert rows(out.select("id", "z.a", "z.renamed")) == [(1, 1, "a"), (1, 2, None), (2, None, None), (3, None, None)]


def test_zip_explode_strict(arrays):
    with pytest.raises(PySparkException, match="unequal length"):
        fl.zip_explode_cols(arrays, ["a", "b"], "z", strict=True).collect()
    even = arrays.where("id = 2")
    assert fl.zip_explode_cols(even, ["a", "b"], "z", strict=True, outer=True).count() == 1


def test_zip_explode_dotted_names(spark):
    df = spark.createDataFrame([([1], ["x"])], "`p.q` array<int>, r array<string>")
    out = fl.zip_explode_cols(df, ["p.q", "r"], "z", {"p.q": "new.name"})
    assert rows(out.select(F.col("z").getField("new.name"), "z.r")) == [(1, "x")]


def test_flatten(spark):
    df = spark.createDataFrame(
        [([([(1,), (2,)],)], ([(5,)],), [[1], [2, 3]], {"k": (1,)}, [[(7,)]])],
        "a array<struct<b:array<struct<c:int>>>>, s struct<arr:array<struct<x:int>>>, m array<array<int>>, "
        "d map<string, struct<v:int>>, aa array<array<struct<x:int>>>")
    out = fl.flatten(df)
    assert out.columns == ["a_b_c", "s.arr_x", "m", "d", "aa__x"]
    row = out.collect()[0]
    assert row[0] == [[1, 2]] and row[1] == [5] and row[2] == [[1], [2, 3]] and row[4] == [[7]]
    assert row[3]["k"].v == 1


def test_flatten_three_levels_and_null(spark):
    df = spark.createDataFrame([([([([(1, "u")],), None],)],), (None,)],
                               "a array<struct<b:array<struct<c:array<struct<d:int, e:string>>>>>>")
    out = fl.flatten(df)
    assert out.columns == ["a_b_c_d", "a_b_c_e"]
    assert out.collect()[0][0] == [[[1], None]] and out.collect()[1][0] is None


def test_flatten_is_idempotent(spark):
    df = spark.createDataFrame([((1, (2,)), "x")], "s struct<a:int, t:struct<b:int>>, c string")
    once = fl.flatten(df)
    assert once.columns == ["s.a", "s.t.b", "c"]
    twice = fl.flatten(once)
    assert twice.columns == once.columns and rows(twice) == rows(once)


def test_flatten_collision_and_empty_struct(spark):
    with pytest.raises(ValueError, match="colliding"):
        fl.flatten(spark.createDataFrame([(1, [(2,)])], "a_b int, a array<struct<b:int>>"))
    assert leaf_paths(spark.createDataFrame([], "e struct<>, x int").schema) == [("x",)]


def test_flatten_prunes_array_of_struct(spark, tmp_path):
    spark.range(2).select(F.array(F.struct(F.lit(1).alias("p"), F.lit(2).alias("q"))).alias("a")).write.parquet(
        str(tmp_path / "a"))
    out = fl.flatten(spark.read.parquet(str(tmp_path / "a"))).select("a_p")
    assert "a:array<struct<p:int>>" in out._jdf.queryExecution().executedPlan().toString()


def test_normalise_every_level(spark):
    df = spark.createDataFrame([((1, [(2,)]), {"k": (3,)})],
                               "`top @` struct<`in ner`:int, `l@`:array<struct<`x y`:int>>>, m map<string, struct<`v+`:int>>")
    out = fl.normalise_fields_names(df)
    assert out.schema.simpleString() == ("struct<top%20%40:struct<in%20ner:int,l%40:array<struct<x%20y:int>>>,"
                                         "m:map<string,struct<v%2B:int>>>")
    assert out.collect()[0][1]["k"][0] == 3
    with pytest.raises(ValueError, match="colliding"):
        fl.normalise_fields_names(spark.createDataFrame([(1, 2)], "`a ` int, ` A` int"))


NAMES = {" a b@c/d~*+ü ": "a%20b%40c/d~%2A%2B%C3%BC", " x\t": "x", "%41+b": "%2541%2Bb", "a%zz": "a%25zz",
         "  nb\x1c": "nb", "": ""}


def test_name_fixtures(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", encode_names("n").alias("e"))
    assert {r.n: r.e for r in df.collect()} == NAMES
    assert {n: fl.normalise_name(n) for n in NAMES} == NAMES


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")) | st.text("%aF0+ /~é"),
                min_size=1, max_size=40))
def test_column_and_python_coding_agree(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", encode_names("n"), decode_names("n"),
                                                                         decode_names(encode_names("n")))
    for name, encoded, decoded, back in df.collect():
        assert encoded == fl.normalise_name(name)
        assert decoded == fl.denormalise_name(name)
        # the decoder strips what stripping left, which is nothing
        assert back == name.strip()


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs", "Cc"]) | st.sampled_from("`.@ "), min_size=1, max_size=12))
def test_any_name_can_be_quoted(spark, name):
    df = spark.range(1).select(F.lit(7).alias(name))
    assert df.select(quoted(name)).collect() == [(7,)]


def test_select_nested_fields_spec():
    spec = {"vep": {"any": ["transcript_ablation.max", "stop_gained.max"]}}
    assert [a for a, _ in fl.select_nested_fields(spec)] == [
        "vep.any.transcript_ablation.max", "vep.any.stop_gained.max"]
    assert [a for a, _ in fl.select_nested_fields(["x", {"s": "y"}], sep="/")] == ["x", "s/y"]
    with pytest.raises(ValueError):
        fl.select_nested_fields({"a": 5})


def test_select_nested_fields_values(spark):
    df = spark.createDataFrame([(((1.0, 2.0),), {"k": 3}, [(4,), (5,)])],
                               "vep struct<any: struct<`transcript_ablation.max`:double, `stop_gained.max`:double>>, "
                               "m map<string,int>, a array<struct<x:int>>")
    spec = [{"vep": {"any": ["transcript_ablation.max", "stop_gained.max"]}}, {"m": "k"}, {"a": "x"}]
    assert df.select(*(c for _, c in fl.select_nested_fields(spec))).collect() == [(1.0, 2.0, 3, [4, 5])]


def test_rename_values(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "k string")
    def values(*args):
        return [r[0] for r in df.select(fl.rename_values("k", *args)).collect()]
    assert values({"a": 1}) == [1, None, None]
    assert values({"a": 1}, -1) == [1, -1, -1]
    assert values({}, "d") == ["d"] * 3
    assert values({"a": "x"}, "k") == ["x", "k", "k"]
    assert values({"a": "x"}, F.col("k")) == ["x", "q", None]


@pytest.mark.parametrize("size", [1, 300])
def test_rename_column_values_both_ways(spark, size):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "k string")
    mapping = {"a": 1, **{f"extra{i}": i for i in range(size - 1)}}
    assert [r[0] for r in fl.rename_column_values(df, "k", mapping).collect()] == [1, None, None]
    out = fl.rename_column_values(df, "k", mapping, -1, "code")
    assert out.columns == ["k", "code"] and [r.code for r in out.collect()] == [1, -1, -1]


def test_melt(spark):
    df = spark.createDataFrame([(1, 5, None, "t")], "`i.d` int, a int, `b.c` int, other string")
    out = fl.melt(df, ("i.d",), ["a", "b.c"])
    assert out.columns == ["i.d", "variable", "value"] and rows(out) == [(1, "a", 5), (1, "b.c", None)]
    mixed = fl.melt(df, ["i.d"], ["a", "other"], "var", "val", cast_to="string")
    assert rows(mixed) == [(1, "a", "5"), (1, "other", "t")]


def test_display_head(spark):
    assert len(fl.display_head(spark.range(9))) == 5


def test_row_wise_operators_on_a_stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("embedding2", F.col("embedding"))
    source.write.parquet(str(tmp_path / "in"))

    def job(df):
        zipped = fl.zip_explode_cols(df, ["embedding", "embedding2"], "cell", drop_sources=True)
        flat = fl.flatten(zipped).select("vec_id", *map(quoted, ["cell.embedding", "cell.embedding2"]))
        return fl.melt(flat, ["vec_id"], ["cell.embedding", "cell.embedding2"])

    stream = job(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    assert stream.isStreaming
    run = stream.writeStream.format("memory").queryName("melted").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = job(source)
    assert spark.table("melted").exceptAll(batch).count() == 0 and spark.table("melted").count() == batch.count()


@pytest.mark.parametrize("size", [10, 1000])
@pytest.mark.parametrize("value, kind", [(lambda k: k, "int"), (lambda k: None, "void"), (lambda k: k if k % 2 else k / 4, "double"),
                                         (lambda k: 1 << 40 if k == 3 else k, "bigint"), (lambda k: str(k), "string"), (lambda k: None if k % 2 else k, "int")])
def test_dictionaries_of_any_size_have_one_type(spark, size, value, kind):
    table = {k: value(k) for k in range(size)}
    df = spark.createDataFrame([(k,) for k in (0, 3, 8, 10**6)] + [(None,)], "k int")
    out = fl.rename_column_values(df, "k", table, result="v")
    assert out.schema["v"].dataType.simpleString() == kind
    assert {r.k: r.v for r in out.collect()} == {k: table.get(k) for k in (0, 3, 8, 10**6, None)}


def test_python_whitespace_in_patterns():
    from featloom.functions.names import java_regex
    assert java_regex(r"\\s|a\s") == "(?U)" + r"\\s|a[\s\x1c-\x1f]"
    assert java_regex(r"[^\s_]\[\s") == "(?U)" + r"[^\s\x1c-\x1f_]\[[\s\x1c-\x1f]"
