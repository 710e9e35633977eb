"""Digest enrichment: which files are hashed, with what outcome, and the write-back.

Bytes are digested where they are read. Only the short digest rows are shuffled to meet the
inventory; file content never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from ..model import SIZE_LIMIT

FILE_KEY = ("snapshot_id", "volume", "frn")


def hash_candidate(is_dir: str = "is_dir", size: str = "size") -> Column:
    """Regular, non-empty and at most 200 MiB."""
    return ~F.col(is_dir) & F.col(size).between(1, SIZE_LIMIT)


def pe_like(path: Column, is_mz: Column) -> Column:
    """Extension of the whole path, or the ``MZ`` magic."""
    return paths.has_pe_path_extension(path) | F.coalesce(is_mz, F.lit(False))


def content_digests(content: DataFrame, second_digest: str | None = None) -> DataFrame:
    """One row per readable file: its magic test and, if executable-like, its digests."""
    is_mz = values.starts_with_mz(F.col("content"))
    wanted = paths.has_pe_path_extension(F.col("path")) | is_mz
    readable = content.filter(F.col("content").isNotNull())
    return readable.select(
        "volume",
        "path",
        is_mz.alias("is_mz"),
        F.when(wanted, values.sha256_hex(F.col("content"))).alias("new_sha256"),
        F.when(wanted, values.second_digest(F.col("content"), second_digest)).alias("new_digest2"),
    )


def one_per_path(digests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row per key; of several the same one in every run."""
    rest = [c for c in digests.columns if c not in key]
    picked = digests.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in digests.columns])


def with_outcome(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files with ``outcome``: hashed, skipped, failed, or null when not a candidate.

    A path that ``digests`` lists more than once counts once; one that many rows share is a skewed
    left side, which adaptive execution can split.
    """
    d = one_per_path(
        digests.select(
            F.xxhash64("volume", "path").alias("_slot"),
            F.col("volume").alias("_volume"),
            F.col("path").alias("_path"),
            F.col("is_mz").alias("_is_mz"),
            F.col("new_sha256").alias("_sha256"),
            F.col("new_digest2").alias("_digest2"),
        ),
        ("_slot", "_path", "_volume"),
    )
    f = files.withColumn("_row_slot", F.xxhash64("volume", "path"))
    joined = f.join(
        d,
        (F.col("_row_slot") == F.col("_slot"))
        & (f["path"] == F.col("_path"))
        & (f["volume"] == F.col("_volume")),
        "left",
    )
    outcome = F.when(
        hash_candidate(),
        F.when(F.col("_path").isNull(), F.lit("failed"))
        .when(pe_like(F.col("path"), F.col("_is_mz")), F.lit("hashed"))
        .otherwise(F.lit("skipped")),
    )
    return joined.withColumn("outcome", outcome).drop("_row_slot", "_slot", "_volume", "_path", "_is_mz")


def enrich_files(files: DataFrame, content: DataFrame, second_digest: str | None = None) -> DataFrame:
    """Inventory rows with fresh digests where the outcome is hashed; other rows unchanged.

    Keeps the ``outcome`` column so that :func:`hash_stats` can count from the same pass.
    """
    outcome = with_outcome(files, content_digests(content, second_digest))
    hashed = F.coalesce(F.col("outcome") == "hashed", F.lit(False))
    return (
        outcome.withColumn("sha256", F.when(hashed, F.col("_sha256")).otherwise(F.col("sha256")))
        .withColumn("digest2", F.when(hashed, F.col("_digest2")).otherwise(F.col("digest2")))
        .drop("_sha256", "_digest2")
    )


def write_back_digests(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Update by key: rows of ``digests`` replace both digest columns, the rest stay.

    ``digests``: ``snapshot_id, volume, frn, sha256, digest2``, one row per key.
    """
    new = digests.select(
        *[F.col(k).alias("_" + k) for k in FILE_KEY],
        F.col("sha256").alias("_sha256"),
        F.col("digest2").alias("_digest2"),
    )
    joined = files.join(
        new,
        (files["frn"] == F.col("_frn"))
        & (files["volume"] == F.col("_volume"))
        & (files["snapshot_id"] == F.col("_snapshot_id")),
        "left",
    )
    hit = F.col("_frn").isNotNull()
    out = []
    for c in files.columns:
        if c in ("sha256", "digest2"):
            out.append(F.when(hit, F.col("_" + c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def hash_stats(outcomes: DataFrame) -> DataFrame:
    """Considered, hashed and failed files."""
    return outcomes.agg(
        F.count("outcome").alias("considered"),
        F.count_if(F.col("outcome") == "hashed").alias("hashed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def same_hash_groups(files: DataFrame) -> DataFrame:
    """Hashes found on more than one row over all snapshots."""
    return (
        files.filter(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.min("snapshot_id").alias("first_snapshot"),
            F.max("snapshot_id").alias("last_snapshot"),
        )
        .filter(F.col("n_files") > 1)
    )


def same_hash_files(files: DataFrame) -> DataFrame:
    """Every row whose hash occurs more than once: rows, never pairs of rows."""
    groups = same_hash_groups(files).select("sha256")
    return files.join(groups, "sha256", "left_semi").select(
        "sha256", "snapshot_id", "volume", "frn", "path"
    )
