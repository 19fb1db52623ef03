import itertools
import random

import pytest
from pyspark.sql import functions as F

import featloom as fl
from featloom.plans.ordered import with_position
from featloom.plans.skew import SkewPolicy

from .conftest import rows

SIZES = {"dim_0": 6, "dim_1": 5, "dim_2": 4, "dim_3": 2, "nodim_a": 3, "nodim_b": 3}
CORE = ["dim_0", "dim_1", "dim_2"]


def cells(spark, rng, dims, draw):
    data = [(*idx, draw(rng)) for idx in itertools.product(*(range(SIZES[d]) for d in dims))]
    kind = "boolean" if isinstance(data[0][-1], bool) else "int"
    df = spark.createDataFrame(data, ", ".join(f"{d} int" for d in dims) + f", value {kind}")
    return df, {row[:-1]: row[-1] for row in data}


@pytest.fixture(scope="module")
def dataset(spark):
    rng = random.Random(11)
    number = lambda r: r.randrange(1000)
    spec = {"a": (CORE + ["dim_3"], number), "x": (CORE, number), "y": (CORE[:2], number),
            "z": (["nodim_a", "nodim_b"], number), "missing": (CORE, lambda r: r.random() < 0.5)}
    built = {name: cells(spark, rng, *how) for name, how in spec.items()}
    return {n: df for n, (df, _) in built.items()}, {n: values for n, (_, values) in built.items()}


def selected(values):
    return sorted(idx for idx, on in values["missing"].items() if on)


def test_labels_and_positions(dataset):
    frames, values = dataset
    mask = frames["missing"].withColumnRenamed("value", "mask")
    labels = fl.core_dim_labels_from_mask(mask, CORE, "newdim")
    assert labels.columns == ["newdim", *CORE]
    assert rows(labels) == [(i, *idx) for i, idx in enumerate(selected(values))]
    assert rows(fl.core_dim_labels_from_mask(mask, CORE)) == selected(values)


def test_mask_indexed_by_itself(dataset):
    frames, values = dataset
    mask = frames["missing"].withColumnRenamed("value", "mask")
    out = fl.subset_variable(frames["missing"], fl.core_dim_labels_from_mask(mask, CORE), CORE)
    assert out.columns == [*CORE, "value"] and all(r.value for r in out.collect())
    assert out.count() == len(selected(values))


@pytest.mark.parametrize("persist, dense, skew", [(True, True, None), (False, False, SkewPolicy(3, 1.0))])
def test_whole_dataset(dataset, persist, dense, skew):
    frames, values = dataset
    mask = frames["missing"].withColumnRenamed("value", "mask")
    out = fl.dataset_masked_indexing(frames, mask, CORE, persist=persist, dense=dense, skew=skew)
    keep = selected(values)
    assert rows(out["x"]) == [(*i, values["x"][i]) for i in keep]
    assert rows(out["y"]) == [(*i, values["y"][i[:2]]) for i in keep]  # repeated over dim_2
    assert rows(out["a"]) == [(*i, k, values["a"][(*i, k)]) for i in keep for k in range(2)]
    assert out["z"] is frames["z"]
    assert all(r.value for r in out["missing"].collect())
    out.unpersist()


def test_absent_cells_are_null_and_foreign_cells_ignored(spark):
    mask = spark.createDataFrame([(0, True), (1, True), (2, False)], "d int, mask boolean")
    variable = spark.createDataFrame([(0, "p", 5), (0, "q", 6), (2, "p", 7), (9, "p", 8)], "d int, e string, value int")
    labels = fl.core_dim_labels_from_mask(mask, ["d"])
    assert rows(fl.subset_variable(variable, labels, ["d"])) == [
        (0, "p", 5), (0, "q", 6), (1, "p", None), (1, "q", None)]
    assert rows(fl.subset_variable(variable, labels, ["d"], dense=False)) == [
        (0, "p", 5), (0, "q", 6), (1, None, None)]
    with pytest.raises(ValueError):
        fl.subset_variable(variable.drop("d"), labels, ["d"])


def test_null_in_mask_is_not_selected(spark):
    mask = spark.createDataFrame([(0, None), (1, True)], "d int, mask boolean")
    assert rows(fl.core_dim_labels_from_mask(mask, ["d"])) == [(1,)]


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("same").alias("c")).repartition(9)
    out = with_position(df, [F.col("c"), F.col("v").desc()], "n")
    assert out.where(F.col("n") + F.col("v") != 4999).count() == 0 and out.count() == 5000


def test_dense_array(spark):
    df = spark.createDataFrame([(7, [0.5, 1.5])], "id int, v array<double>")
    assert rows(fl.dense_array(df, "v", ["id"], "pos")) == [(7, 0, 0.5), (7, 1, 1.5)]
