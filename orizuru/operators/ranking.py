"""Ranks over tables of any size: no window holds more than a partition's count.

The rows are sorted by range partitioning, numbered inside their partition, and written once to the shared folder, as
the bounds of the ranges come from a sample that another evaluation might draw anew. The place of a row is its number
plus the rows of all partitions before; ranks within groups take off the rows before the group's first. Many equal
keys, or one group with a third of all rows, are split by the later sort keys, which end in a unique one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orizuru.session import cut

_ROWS = (1 << 33) - 1  # `monotonically_increasing_id` holds the partition above these bits


def placed(rows: DataFrame, order: Sequence[Column | str], rank: str, groups: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """`rows` with the row number in `order`, from 1, within each of the `groups` (columns), and the rows of the group."""
    keys = [F.col(g) for g in groups]
    numbered = cut(rows.orderBy(*keys, *order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = numbered.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_at", F.col("_before") + F.col("_m").bitwiseAND(F.lit(_ROWS)) + 1)
    if groups or total:
        heads = out.groupBy(*groups).agg((F.min("_at") - 1).alias("_head"), F.count("*").alias("_n"))
        out = out.join(heads, list(groups)) if groups else out.join(F.broadcast(heads))  # one row without groups
        out = out.withColumn("_at", F.col("_at") - F.col("_head"))
    out = out.withColumn(rank, F.col("_at").cast("int"))
    return (out.withColumn(total, F.col("_n")) if total else out).drop("_m", "_p", "_before", "_at", "_head", "_n")


def first_placed(rows: DataFrame, order: Sequence[Column | str], rank: str, limit: int) -> DataFrame:
    """The first `limit` rows with their number: a top-k of each partition, then a window over those `limit` rows."""
    return rows.orderBy(*order).limit(limit).withColumn(rank, F.row_number().over(W.orderBy(*order)))
