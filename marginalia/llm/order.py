"""Places of rows in their groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settle
from ..operators.skew import fits

FEW = 50_000  # rows that may be broadcast; more are joined by shuffle
_PART = 33  # monotonically_increasing_id keeps the partition above this bit


def few(df: DataFrame) -> DataFrame:
    """``df``, settled already, with a hint to broadcast it if it has at most ``FEW`` rows."""
    return F.broadcast(df) if fits(df, FEW) else df


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (place in its group from 0, in the order of ``order``), ``n`` (rows of the group) and ``first``, a long for the group
    that ascends as the group does; the numbers ``first`` + ``at`` are unique over all rows. ``group`` holds no nulls.

    One range sort over all rows spreads a hot group over as many tasks as it needs. Only the counts of (group, partition) meet in a window,
    at most one row for every partition that a group reaches into.
    """
    placed = settle(rows.orderBy(group, *order).withColumn("_id", F.monotonically_increasing_id()))
    parts = placed.groupBy(group, F.shiftright("_id", _PART).alias("_part")).agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    every = Window.partitionBy(group)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select(
        group, "_part", "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(every).alias("n"), F.min("_low").over(every).alias("first")))
    joined = placed.withColumn("_part", F.shiftright("_id", _PART)).join(few(parts), [group, "_part"])
    return joined.withColumn("at", F.col("_id") - F.col("_low") + F.col("_before")).drop("_id", "_part", "_low", "_before")
