"""Row numbers inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import pinned


def rank_in_groups(
    df: DataFrame, group: list[str], order: list[str], name: str, counted: Column | None = None
) -> DataFrame:
    """Add ``name``: how many counted rows of the group come up to and including this row.

    The rows are range-partitioned by group *and* order, so a group that holds a third of all
    rows is spread over a third of the tasks. Inside a sorted partition the generated row id
    runs in order; a running count per piece of a group, plus the totals of the pieces before
    it, gives the number. ``order`` must be total within a group. The layout is pinned by a
    reliable checkpoint because both halves below must see the same pieces.
    """
    counted = F.lit(True) if counted is None else counted
    laid_out = pinned(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    piece_key = [*group, "_piece"]
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        laid_out.groupBy(*piece_key)
        .agg(F.count_if(counted).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_piece = Window.partitionBy(*piece_key).orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = F.count_if(counted).over(in_piece)
    return (
        laid_out.withColumn("_running", running)
        .join(offsets, piece_key)
        .withColumn(name, F.col("_offset") + F.col("_running"))
        .drop("_running", "_offset", "_piece", "_place")
    )
