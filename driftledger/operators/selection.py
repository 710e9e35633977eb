"""Volume selectors and ingest-time row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CompiledRules


def normalize_selector(text: str) -> str:
    return text.strip().rstrip("\\").rstrip(":").upper()


def volume_selected(volume: Column, selectors: Iterable[str]) -> Column:
    """The label, or the label without its colon, is one of the selectors (case-blind)."""
    wanted = sorted({normalize_selector(s) for s in selectors})
    label = F.upper(volume)
    return label.isin(*wanted) | F.rtrim(label, F.lit(":")).isin(*wanted)


def filter_volumes(
    df: DataFrame, volumes: Iterable[str] = (), exclude_volumes: Iterable[str] = ()
) -> DataFrame:
    """Whitelist first, then blacklist; an empty list does not filter."""
    volumes, exclude_volumes = list(volumes), list(exclude_volumes)
    if volumes:
        df = df.filter(volume_selected(F.col("volume"), volumes))
    if exclude_volumes:
        df = df.filter(~volume_selected(F.col("volume"), exclude_volumes))
    return df


def scan_kept(path: Column, rules: CompiledRules) -> Column:
    """Records that enter the inventory: a resolvable path that no rule excludes."""
    excluded = rules.excludes(path)
    kept = F.coalesce(path != "", F.lit(False))
    return kept if excluded is None else kept & ~excluded


def scan_stats(records: DataFrame, rules: CompiledRules = CompiledRules()) -> DataFrame:
    """Per volume: records seen, sent on, and skipped by the filters."""
    kept = scan_kept(F.col("path"), rules)
    return (
        records.groupBy("volume")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("sent"))
        .withColumn("skipped", F.col("total") - F.col("sent"))
    )


def volume_counts(files: DataFrame) -> DataFrame:
    """Volumes present in every snapshot, with their number of rows."""
    return files.groupBy("snapshot_id", "volume").agg(F.count(F.lit(1)).alias("n_files"))
