"""Shards by balanced label propagation.

Documents that share a key (here: equal texts) are linked. From a start by hash, each document wishes to be in
the shard that holds most of those it is linked to. For every pair of shards, wishes in both directions can be
swapped, and beyond swaps a shard takes what its capacity leaves; a hash of the key decides which
groups go first. Links are never expanded: a round counts rows by (key, shard), and joins the wish back on the key.

At the end all documents stand in one order: by shard, and within a shard groups in the middle. That order is cut
into runs of equal count, so counts are at most one apart whatever the quotas left, and mostly unlinked documents move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import with_position
from .shared import checkpointed

SHARDS, ROUNDS = 16, 6
# How far above the mean a shard may be during propagation.
SLACK = 0.05


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``rows`` of ``key`` and ``shard`` with the shards after propagation; other columns stay.

    Null keys are linked to nothing. A key with more rows than a shard can take fills it and stays in its others.
    """
    capacity = rows.count() / shards * (1 + slack)
    sizes = rows.where("key IS NOT NULL").groupBy("key").count().where("count > 1").select("key")
    rows = checkpointed(rows.join(checkpointed(sizes).withColumn("linked", F.lit(True)), "key", "left")
                        .withColumn("linked", F.coalesce("linked", F.lit(False))))
    for number in range(rounds):
        wishes = (rows.where("linked").groupBy("key", "shard").count().groupBy("key")
                  .agg(F.max(F.struct("count", F.xxhash64("key", "shard").alias("tie"), "shard"))["shard"].alias("wish")))
        wished = rows.join(checkpointed(wishes), "key", "left").withColumn("wish", F.coalesce("wish", "shard"))
        wished = checkpointed(wished)
        flows = {(r.shard, r.wish): r["count"] for r in wished.groupBy("shard", "wish").count().collect()}  # shards squared at most
        held = [sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)]
        moves = {pair: n for pair, n in flows.items() if pair[0] != pair[1]}
        share = {}
        for to in range(shards):
            incoming = {a: n for (a, b), n in moves.items() if b == to}
            swaps = {a: min(n, moves.get((to, a), 0)) for a, n in incoming.items()}
            beyond = sum(incoming.values()) - sum(swaps.values())
            room = min(1.0, max(0.0, capacity - held[to]) / beyond) if beyond else 0.0
            share |= {(a, to): (swaps[a] + room * (n - swaps[a])) / n for a, n in incoming.items()}
        if not any(share.values()):
            break
        chance = F.pmod(F.xxhash64("key", F.lit(number)), F.lit(1 << 30)) / (1 << 30)
        limit = F.element_at(F.create_map(*(F.lit(x) for (a, b), f in share.items() for x in (a * shards + b, f))),
                             (F.col("shard") * shards + F.col("wish")).cast("int"))
        rows = wished.withColumn("shard", F.when((F.col("shard") != F.col("wish")) & (chance < F.coalesce(limit, F.lit(0.0))), F.col("wish"))
                                 .otherwise(F.col("shard"))).drop("wish")
    return rows


def assign_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    The law is ``rows``: counts of shards are at most one apart. Size is the UTF-8 bytes of the text and one more; a null text
    counts as empty and equal to an empty one. Rows of equal id and text are equal, so it does not matter which takes which
    slot. Null ids are dealt like any others. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"),
                       F.md5(whole.cast("binary")).alias("key"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int"))
    placed = propagate(rows, shards, rounds)
    side = F.when(F.col("linked"), 1).otherwise(2 * F.pmod(F.xxhash64("key", F.lit("side")), F.lit(2)))
    order = [F.col("shard"), F.col("side"), F.col("key"), F.col("id").asc_nulls_first()]
    numbered = with_position(placed.withColumn("side", side), order, "place")
    # the first (total mod shards) shards take one more
    total = numbered.count()
    small, more = divmod(total, shards)
    border = more * (small + 1)
    p = F.col("place")
    shard = F.when(p < border, F.floor(p / (small + 1))).otherwise(F.lit(more) + F.floor((p - border) / max(small, 1))).cast("int")
    slot = F.when(p < border, p % (small + 1)).otherwise((p - border) % max(small, 1)).cast("long")
    return numbered.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                           shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal count, equal texts together as far as they fit."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
