"""Nested form of a diff report, one JSON entry per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values


def side_struct(tag: str) -> Column:
    """One side of a change, null when absent; file ids are shown unsigned."""
    side = F.struct(
        F.col("volume"),
        values.unsigned_id(F.col(f"{tag}_frn")).alias("frn"),
        F.col(f"{tag}_path").alias("path"),
        F.col(f"{tag}_size").alias("size"),
        F.col(f"{tag}_mtime").alias("mtime"),
        F.col(f"{tag}_sha256").alias("sha256_hex"),
    )
    return F.when(F.col(f"{tag}_frn").isNotNull(), side)


def change_entries(changes: DataFrame) -> DataFrame:
    """``category`` and the nested entry ``(kind, before, after)``."""
    entry = F.struct(
        "kind", side_struct("before").alias("before"), side_struct("after").alias("after")
    )
    return changes.select("category", entry.alias("entry"))


def report_json(changes: DataFrame) -> DataFrame:
    """``category`` and the entry as JSON text, nulls written out."""
    return change_entries(changes).select(
        "category", F.to_json("entry", {"ignoreNullFields": "false"}).alias("entry_json")
    )


def write_report(changes: DataFrame, path: str, before_name: str, after_name: str) -> None:
    """JSON lines below ``path``, a folder per category, plus the two snapshot names.

    A report is as large as its changes, so it is never assembled into one document.
    """
    spark = changes.sparkSession
    change_entries(changes).select("category", "entry.*").write.mode("overwrite").partitionBy(
        "category"
    ).option("ignoreNullFields", "false").json(f"{path}/changes")
    names = spark.createDataFrame(
        [(before_name, after_name)], "before_snapshot string, after_snapshot string"
    )
    names.coalesce(1).write.mode("overwrite").json(f"{path}/snapshots")
