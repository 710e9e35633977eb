"""Scan records to inventory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FILE_SCHEMA
from .rules import CompiledRules
from .selection import scan_kept

KEY = ("volume", "frn")


def latest_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """Keyed upsert: the last record of every ``(volume, frn)`` wins.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle too, so
    a key that repeats without end sends one row per task, not all of its rows.
    """
    newest_first = Window.partitionBy("frn", "volume").orderBy(F.col(order).desc())
    return (
        records.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def inventory_rows(
    records: DataFrame, snapshot_id: int, rules: CompiledRules = CompiledRules()
) -> DataFrame:
    """Filtered, upserted rows of one snapshot in table order, digests still null."""
    kept = latest_records(records.filter(scan_kept(F.col("path"), rules)))
    present = set(records.columns)
    columns = []
    for f in FILE_SCHEMA:
        if f.name == "snapshot_id":
            value = F.lit(snapshot_id)
        elif f.name in ("sha256", "digest2"):
            value = F.lit(None)
        elif f.name == "parent_frn" and f.name not in present:
            value = F.lit(0)
        else:
            value = F.col(f.name)
        columns.append(value.cast(f.dataType).alias(f.name))
    return kept.select(*columns)
