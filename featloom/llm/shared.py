"""Folders that driver and executors share, and small helpers of the corpus operators."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.storage import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "forget_encoders", "new_folder", "rewritten", "unused"]


def new_folder(spark: SparkSession, label: str) -> str:
    """Address of a new folder below the shared checkpoint folder; nothing is created yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends here."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget_encoders() -> None:
    """Lets go of the encoders that this Python worker keeps from earlier tasks, and of all that they remember.

    Operators call it whose tasks need the memory and that may run in workers that have encoded texts.
    """
    kept = getattr(sys.modules.get("tokenizers"), "_encoders_by_path", None)
    if kept:
        kept.clear()


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores in front until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
