"""Running totals and positions over one global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import named_col
from .storage import checkpointed

# Column that holds the group of a row as a struct, so that nulls in it are equal.
GROUP = "__group"
# Bits of a number's mantissa that tell the digits of the two upper levels apart; its exponent is part of the first.
DIGITS = (10, 21)
_LEVELS = ("__digit1", "__digit2")
DIGIT = _LEVELS[0]


def _digits(number: Column, bits: Sequence[int]) -> list[Column]:
    """Two digits of a double, in the order of the numbers: the second orders the numbers of equal first ones, as far as it goes.

    The first is sign, exponent and the leading bits of the mantissa; the second the bits that follow. Exponents come from a logarithm
    that never falls as its argument grows, so a rounding error moves a border between digits but keeps the order.
    """
    size = F.abs(number)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent.cast("double"))  # 1 to 2
    first = (exponent + 1_100) * (1 << bits[0] + 1) + F.floor(mantissa * float(1 << bits[0]))
    fine = F.floor(mantissa * float(1 << sum(bits)))
    sign = F.when(number < 0, F.lit(-1)).otherwise(F.lit(1))
    ends = F.lit(1 << 40)  # beyond every other digit

    def signed(value: Column, infinite: Column) -> Column:
        digit = F.when(size == 0, F.lit(0)).when(size == float("inf"), sign * infinite).otherwise(sign * value).cast("long")
        # never null, so that a join on digits adds no filter to one side: equal sides are then computed once
        return F.coalesce(digit, F.lit(0).cast("long"))
    return [signed(first, ends), signed(F.pmod(fine, F.lit(1 << bits[1])), F.lit(0))]


def running_totals(df: DataFrame, group: Sequence[str], by: str, running: Mapping[str, Column], totals: Mapping[str, Column] | None = None,
                   digits: Sequence[int] = DIGITS) -> DataFrame:
    """Add inclusive running sums of ``running`` along descending ``by`` within each group, and sums ``totals`` over the whole group.

    ``by`` is a double that no two rows of a group share, and not NaN; null is a group like any other. Numbers are cut to two digits and a
    rest, like the levels of a tree. Sums of the digits, each started by the level above, give the rows of a
    pair of digits their starting value, so every window is bounded by what its level can tell apart, however the numbers
    are distributed: a few million rows for digits, 2^21 for rows. Nothing is sampled, counted or stored: the plan is lazy, is the same
    at every size, and gives the same on every run. Rows are dealt out by their digits once; the sums of
    a pair of digits are the last running sums of its rows, so no task holds both the rows and a hash table of their digits.
    The result has the group as a struct (:data:`GROUP`) and the first digit (:data:`DIGIT`) as well.
    """
    keys = [named_col(c) for c in group]
    totals = totals or {}
    sums = dict(running)
    one, two = ([GROUP, *_LEVELS[:n]] for n in (1, 2))
    base = df.withColumns({GROUP: F.struct(*keys), **dict(zip(_LEVELS, _digits(named_col(by), digits)))}).repartition(*two)
    order = Window.partitionBy(*two).orderBy(named_col(by).desc())
    window = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = base.select(*(named_col(c) for c in df.columns), *two, *(F.sum(v).over(window).alias(f"__in_{n}") for n, v in {**totals, **sums}.items()),
                         F.lead(named_col(by)).over(order).isNull().alias("__last"))
    lower = within.where("__last").select(*two, *(F.col(f"__in_{n}").alias(n) for n in [*sums, *totals]))
    upper = lower.groupBy(*one).agg(*(F.sum(named_col(n)).alias(n) for n in [*sums, *totals]))

    def earlier(name: str, partition: list[str], level: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(F.col(level).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(named_col(name)).over(window), F.lit(0))
    above = upper.select(*one, *(earlier(n, [GROUP], _LEVELS[0]).alias(f"__above_{n}") for n in sums),
                         *(F.sum(named_col(n)).over(Window.partitionBy(GROUP)).alias(f"__all_{n}") for n in totals))
    starts = (lower.select(*two, *(earlier(n, one, _LEVELS[1]).alias(f"__start_{n}") for n in sums)).join(above, on=one)
              .select(*two, *((F.col(f"__start_{n}") + F.col(f"__above_{n}")).alias(f"__start_{n}") for n in sums),
                      *(f"__all_{n}" for n in totals)))
    return within.join(starts, on=two).select(
        *(named_col(c) for c in df.columns), *one, *((F.col(f"__start_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums),
        *(F.col(f"__all_{n}").alias(n) for n in totals))


def with_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows 0..n-1 along ``order`` in a new first column.

    Runs a job: rows are range-partitioned, sorted within the ranges and written to the
    checkpoint folder; only the row count of each range -- one number per partition --
    is brought back.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    # the id is (partition number << 33) + row number within the partition
    part = F.shiftright("__id", 33)
    counts = stored.groupBy(part.alias("__slice")).count().orderBy("__slice").collect()
    starts, total = {}, 0
    for row in counts:
        starts[row["__slice"]] = total
        total += row["count"]
    start_table = df.sparkSession.createDataFrame(
        [(s, n) for s, n in starts.items()], "__slice long, __start long")
    position = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (stored.withColumn("__slice", part).join(F.broadcast(start_table), on="__slice")
            .select(position.alias(name), *(named_col(c) for c in df.columns)))
