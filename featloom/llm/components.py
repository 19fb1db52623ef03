"""Connected components of links between documents, as repeated joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``class`` (smallest id reachable) of every id in the columns ``a`` and ``b`` of ``links``.

    Each round every id takes the smallest class among its own, its neighbours' and its class's class, so
    long chains shrink fast. Aggregation starts on the map side, so an id with many
    links is no hot group; its links as a join key are split by adaptive execution. Rounds end with
    a checkpoint, and with the first that changes nothing; only whether one did comes to the driver.
    """
    both = links.select("a", "b").where("a <> b").distinct()
    both = checkpointed(both.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
                        .select("x.a", "x.b"))
    classes = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class"))
    while True:
        seen = both.join(classes.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("m"))
        jump = classes.select(F.col("id").alias("class"), F.col("class").alias("further"))
        step = checkpointed(classes.join(jump, "class", "left").join(seen, "id")
                            .select("id", F.col("class").alias("old"), F.least("class", "further", "m").alias("class")))
        classes = step.select("id", "class")
        if not step.where(F.col("old") != F.col("class")).limit(1).count():
            return classes
