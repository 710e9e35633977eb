"""Batch triage sink: manifest, collected bytes, and rows whose bytes were not readable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import content_digests
from ..operators.manifest import ORDER, collect_content, in_report_order, manifest

ORDER_ONLY = [c for c in ORDER if c != "volume"]


def with_copy_result(rows: DataFrame, content: DataFrame | None) -> DataFrame:
    """``dumped_to``: the target name, or an error text where no bytes were found.

    A row is kept and counted either way. Without a content source the name alone is given.
    """
    if content is None:
        return rows.withColumn("dumped_to", F.col("target_name"))
    known = content.filter(F.col("content").isNotNull()).select(
        F.col("volume").alias("_volume"), F.col("path").alias("_path")
    ).distinct()
    joined = rows.join(
        known,
        (F.col("original_path") == F.col("_path")) & (F.col("volume") == F.col("_volume")),
        "left",
    )
    readable = F.col("_path").isNotNull()
    return joined.withColumn(
        "dumped_to",
        F.when(readable, F.col("target_name")).otherwise(F.lit("<error: no content>")),
    ).drop("_volume", "_path")


def dump_changes(changes: DataFrame, path: str, content: DataFrame | None = None) -> int:
    """Write ``manifest`` (JSON lines in report order) and ``files`` below ``path``.

    Returns the number of manifest rows. Names point at the digest's snapshot; the bytes are
    whatever the content source holds now.
    """
    spark = changes.sparkSession
    digests = None if content is None else content_digests(content)
    rows = with_copy_result(manifest(changes, digests), content)
    target = f"{path}/manifest"
    in_report_order(rows).drop(*ORDER_ONLY, "target_name").write.mode(
        "overwrite"
    ).option("ignoreNullFields", "false").json(target)
    if content is not None:
        kept = rows.filter(F.col("dumped_to") == F.col("target_name"))
        collect_content(kept, content).write.mode("overwrite").parquet(f"{path}/files")
    return spark.read.schema("dumped_to string").json(target).count()
