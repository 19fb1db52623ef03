"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.decontam import decontaminated
from featloom.llm.mixing import mixture_of
from featloom.llm.neardup import deduplicated
from featloom.llm.rules import passing
from featloom.llm.shared import rewritten
from featloom.llm.tokenpack import token_digest

#: Of all tokens after mixing.
MIXTURE = {"clean": 0.98, "toxic": 0.02}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or a learned rule rejects."""
    return passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near-duplicates."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which the benchmark's windows cover a twentieth or more."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that toxic ones hold 2 % of all tokens, by what ``labels`` teaches of toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domains = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    return mixture_of(docs, domains, MIXTURE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes packed token files and returns the digest of each document, read back from them."""
    return token_digest(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Learned rules and rates are nothing that SQL can express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = rewritten(stage(spark, out, sf_dir), name)
    return out
