"""What Catalyst knows of a frame, and reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

def known_unique(df: DataFrame, on: Sequence[str]) -> bool:
    """Whether Catalyst knows that ``on`` does not repeat, as behind a ``groupBy``."""
    key_sets = df._jdf.queryExecution().optimizedPlan().distinctKeys().toSeq()
    for i in range(key_sets.size()):
        attributes = key_sets.apply(i).toSeq()
        expressions = [attributes.apply(j) for j in range(attributes.size())]
        if all(e.prettyName() == "attributereference" and e.name() in on for e in expressions):
            return True
    return False


# Operators after which rows cost more than a read of their columns.
_COSTLY = ("Exchange", "Join", "Python", "Pandas", "Arrow", "MapPartitions", "Aggregate", "Window", "Generate")


def recomputed_cheaply(df: DataFrame) -> bool:
    """Whether ``df`` is a scan with projections and filters, so that reading a few of its columns once more costs little."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(name in plan for name in _COSTLY)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so lost executors cost no rerun.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from its configuration if need be."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_checkpoint_dir(spark))
    return context.getCheckpointDir()


def _checkpoint_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="featloom-checkpoint-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
