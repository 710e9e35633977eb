"""The scan entry point: records in, a registered snapshot out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import ScanOptions
from ..operators import enrich, ingest
from ..operators.rules import check_rules, compile_rules
from ..operators.selection import filter_volumes, scan_kept
from ..sources.store import SnapshotStore
from ..sources.workdir import fresh_path


@dataclass(frozen=True)
class ScanResult:
    snapshot_id: int
    total: int
    sent: int
    written: int
    considered: int = 0
    hashed: int = 0
    failed: int = 0

    @property
    def skipped(self) -> int:
        return self.total - self.sent


def ingest_snapshot(
    store: SnapshotStore,
    records: DataFrame,
    name: str,
    options: ScanOptions | None = None,
    content: DataFrame | None = None,
    taken_at: int | None = None,
    host: str | None = None,
    note: str | None = None,
    snapshot_id: int | None = None,
) -> ScanResult:
    """Filter, upsert, hash and write one snapshot, then register its name.

    One pass: digests join the rows on their way to the table, so the partition is written
    once. Counters come from observed metrics of that same pass. The name is taken last, so a
    failed run leaves no empty snapshot behind.
    """
    options = options or ScanOptions()
    store.check_name_is_free(name)
    rules = compile_rules(options.rules, options.variables).with_prefixes(options.hidden_paths)
    check_rules(store.spark, rules)
    snapshot_id = store.reserve_id() if snapshot_id is None else snapshot_id

    seen, done = Observation(), Observation()
    selected = filter_volumes(records, options.volumes, options.exclude_volumes)
    selected = selected.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(scan_kept(F.col("path"), rules)).alias("sent"),
    )
    rows = ingest.inventory_rows(selected, snapshot_id, rules)
    if content is not None and options.hash_content:
        rows = enrich.enrich_files(rows, content, options.second_digest)
    else:
        rows = rows.withColumn("outcome", F.lit(None).cast("string"))
    rows = rows.observe(
        done,
        F.count(F.lit(1)).alias("written"),
        F.count("outcome").alias("considered"),
        F.count_if(F.col("outcome") == "hashed").alias("hashed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    store.write_files(_staged(rows), snapshot_id)
    if not seen.get["total"]:
        raise LookupError("no matching volumes to scan")
    store.register(name, snapshot_id, taken_at, host, note)
    return ScanResult(snapshot_id, seen.get["total"], seen.get["sent"], **done.get)


def hash_snapshot(
    store: SnapshotStore, name: str, content: DataFrame, second_digest: str | None = None
) -> dict[str, int]:
    """Hash pass over a stored snapshot; rewrites its partition with the digests."""
    done = Observation()
    rows = enrich.enrich_files(store.files(name), content, second_digest).observe(
        done,
        F.count("outcome").alias("considered"),
        F.count_if(F.col("outcome") == "hashed").alias("hashed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    store.write_files(_staged(rows), store.snapshot_id(name))
    return dict(done.get)


def _staged(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder first: a partition is replaced only when all are there."""
    path = fresh_path(rows.sparkSession, "scan")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
