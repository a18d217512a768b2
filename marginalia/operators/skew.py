"""Helpers for groups that may hold a large share of all rows, and for checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group. Spark plans ``rank <= k`` as a group limit on both sides of the shuffle, so a
    hot group sends at most ``k`` rows per input partition."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def number_within(df: DataFrame, keys: list[str], ord_col: str, name: str = "n") -> DataFrame:
    """1-based position of every row in its group, in ``ord_col`` order, for groups of any size.

    ``ord_col`` is a unique integer. Rows are numbered inside (group, ord bucket), which holds at most 2**16 rows, and
    moved by the size of the earlier buckets. Bucket sizes are counted with partial aggregation, so no task ever sees
    a whole hot group.
    """
    rows = df.withColumn("_bucket", F.shiftright(F.col(ord_col), BUCKET_BITS))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(ord_col)
    numbered = rows.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_local", "_offset")
    )


def fits(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows. Reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit
