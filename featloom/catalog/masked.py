"""Masked selection from N-dimensional data."""

from pyspark.sql import functions as F

from ..operators import masked
from .base import query

_CELLS = """
WITH cells AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
               FROM embeddings),
     picked AS (SELECT row_number() OVER (ORDER BY vec_id, dim) - 1 AS cell, vec_id, dim FROM cells WHERE v > 0.2::DOUBLE)
"""
_CORE = ["vec_id", "dim"]


def _cells(t):
    return masked.dense_array(
        t("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", ["vec_id"], "dim")


def _mask(t):
    return _cells(t).select(*_CORE, (F.col("value") > 0.2).alias("mask"))


@query("mask_labels", _CELLS + "SELECT cell, vec_id, dim FROM picked")
def mask_labels(t):
    return masked.core_dim_labels_from_mask(_mask(t), _CORE, "cell")


@query("masked_variable", _CELLS + "SELECT cell, vec_id, dim, round(v, 6) AS value FROM picked JOIN cells USING (vec_id, dim)")
def masked_variable(t):
    labels = masked.core_dim_labels_from_mask(_mask(t), _CORE, "cell")
    return masked.subset_variable(_cells(t), labels, _CORE).withColumn("value", F.round("value", 6))


@query("masked_variable_extra_dim", _CELLS + """
SELECT vec_id, dim, kind, CASE kind WHEN 'raw' THEN round(v, 6) WHEN 'square' THEN round(v * v, 6) END AS value
FROM picked JOIN cells USING (vec_id, dim), (SELECT unnest(['raw', 'square']) AS kind)""")
def masked_variable_extra_dim(t):
    """The variable has a dimension that the mask lacks; it is kept."""
    cells = _cells(t).select(*_CORE, F.explode(F.create_map(
        F.lit("raw"), F.col("value"), F.lit("square"), F.col("value") * F.col("value"))).alias("kind", "value"))
    labels = masked.core_dim_labels_from_mask(_mask(t), _CORE)
    return masked.subset_variable(cells, labels, _CORE).withColumn("value", F.round("value", 6))


def _dataset(t):
    vectors = t("embeddings")
    return masked.dataset_masked_indexing(
        {"cell": _cells(t), "label": vectors.select("vec_id", F.col("label").alias("value")),
         "part": t("part").select("p_partkey", F.col("p_size").alias("value"))},
        _mask(t), _CORE, persist=False)


@query("masked_dataset", _CELLS + """
SELECT vec_id, dim, round(v, 6) AS cell, label FROM picked JOIN cells USING (vec_id, dim) JOIN embeddings USING (vec_id)""")
def masked_dataset(t):
    """Two variables of one dataset; ``label`` lacks a mask dimension and is repeated over it."""
    data = _dataset(t)
    cell = data["cell"].select(*_CORE, F.round("value", 6).alias("cell"))
    return cell.join(data["label"].withColumnRenamed("value", "label"), _CORE)


@query("masked_dataset_untouched", "SELECT p_partkey, p_size AS value FROM part")
def masked_dataset_untouched(t):
    """A variable without any mask dimension passes as it is."""
    return _dataset(t)["part"]
