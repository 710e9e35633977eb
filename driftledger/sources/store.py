"""Snapshot tables: a registry and a partitioned file inventory in the session catalog."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FILE_SCHEMA, SNAPSHOT_SCHEMA

_SEQUENCE = "driftledger.last_snapshot_id"


class SnapshotExists(ValueError):
    pass


class SnapshotNotFound(LookupError):
    pass


class SnapshotStore:
    """Tables ``{prefix}snapshots`` and ``{prefix}files``.

    Both are partitioned by the snapshot's id, so reading one snapshot prunes to its folder and
    deleting one drops a partition. With ``buckets`` the inventory is also bucketed and sorted by
    ``(volume, frn)``: comparing two snapshots by file id then needs no shuffle at all. Size the
    bucket count for the largest snapshot (about 256 MB a bucket).
    """

    def __init__(
        self, spark: SparkSession, database: str = "default", prefix: str = "", buckets: int = 0
    ) -> None:
        self.spark = spark
        self.buckets = buckets
        self.snapshots_table = f"{database}.{prefix}snapshots"
        self.files_table = f"{database}.{prefix}files"

    def create(self) -> SnapshotStore:
        """Create both tables if they are missing; an existing schema is left alone."""
        layout = "PARTITIONED BY (snapshot_id)"
        if self.buckets:
            layout += (
                f" CLUSTERED BY (volume, frn) SORTED BY (volume, frn) INTO {self.buckets} BUCKETS"
            )
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.files_table} ({_ddl(FILE_SCHEMA)}) USING parquet "
            "OPTIONS ('parquet.bloom.filter.enabled#sha256'='true') " + layout
        )
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.snapshots_table} ({_ddl(SNAPSHOT_SCHEMA)}) "
            "USING parquet PARTITIONED BY (id)"
        )
        return self

    # registry

    def snapshots(self) -> DataFrame:
        return self.spark.table(self.snapshots_table).select(*SNAPSHOT_SCHEMA.fieldNames())

    def list(self) -> DataFrame:
        return list_snapshots(self.snapshots())

    def find(self, name: str) -> T.Row | None:
        rows = self.snapshots().filter(F.col("name") == name).head(1)
        return rows[0] if rows else None

    def snapshot_id(self, name: str) -> int:
        row = self.find(name)
        if row is None:
            raise SnapshotNotFound(f"no snapshot is called '{name}'")
        return row.id

    def reserve_id(self) -> int:
        """The next id, marked as used at once: ids only grow and are never given out again.

        One catalog update, not a lock. Jobs that ingest into one store at the same moment
        should be handed ids by whatever schedules them.
        """
        stored = self.spark.sql(f"SHOW TBLPROPERTIES {self.snapshots_table}")
        last = stored.filter(F.col("key") == _SEQUENCE).head()
        highest = self.snapshots().agg(F.max("id")).head()[0]
        chosen = max(int(last.value) if last else 0, highest or 0) + 1
        self._mark_used(chosen)
        return chosen

    def _mark_used(self, snapshot_id: int) -> None:
        self.spark.sql(
            f"ALTER TABLE {self.snapshots_table} SET TBLPROPERTIES ('{_SEQUENCE}'='{snapshot_id}')"
        )

    def register(
        self,
        name: str,
        snapshot_id: int,
        taken_at: int | None = None,
        host: str | None = None,
        note: str | None = None,
    ) -> int:
        """Add the registry row of a snapshot. Called after its file rows are in place."""
        self.check_name_is_free(name)
        taken = int(time.time()) if taken_at is None else taken_at
        row = self.spark.createDataFrame([(snapshot_id, name, taken, host, note)], SNAPSHOT_SCHEMA)
        row.select("name", "taken_at", "host", "note", "id").write.mode("append").insertInto(
            self.snapshots_table
        )
        return snapshot_id

    def check_name_is_free(self, name: str) -> None:
        if self.find(name) is not None:
            raise SnapshotExists(f"snapshot name '{name}' already exists")

    # file rows

    def files(self, name: str | None = None) -> DataFrame:
        """The inventory of one snapshot, or of all registered ones.

        Rows of a run that failed before it took its name are not part of any snapshot.
        """
        table = self.spark.table(self.files_table).select(*FILE_SCHEMA.fieldNames())
        if name is None:
            registered = self.snapshots().select(F.col("id").alias("snapshot_id"))
            return table.join(registered, "snapshot_id", "left_semi")
        return table.filter(F.col("snapshot_id") == self.snapshot_id(name))

    def write_files(self, rows: DataFrame, snapshot_id: int) -> None:
        """Replace the partition of one snapshot and touch no other one, whatever the session's settings.

        The partition is named in the statement, so it cannot depend on an overwrite mode. A row of
        another snapshot fails the write. ``rows`` must not read the files table itself.
        """
        own = F.assert_true(F.col("snapshot_id").eqNullSafe(snapshot_id), "row of another snapshot")
        columns = [c for c in FILE_SCHEMA.fieldNames() if c != "snapshot_id"]
        rows = rows.where(own.isNull()).select(*columns)
        if self.buckets:
            # one file per bucket, already in bucket order
            rows = rows.repartition(self.buckets, "volume", "frn")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.files_table} PARTITION (snapshot_id = {int(snapshot_id)}) "
            "SELECT * FROM {rows}",
            rows=rows,
        )

    def delete(self, name: str) -> int:
        """Drop the file rows and the registry row; returns how many file rows went."""
        snapshot_id = self.snapshot_id(name)
        removed = self.files(name).count()
        self.spark.sql(
            f"ALTER TABLE {self.files_table} DROP IF EXISTS PARTITION (snapshot_id={snapshot_id})"
        )
        self.spark.sql(
            f"ALTER TABLE {self.snapshots_table} DROP IF EXISTS PARTITION (id={snapshot_id})"
        )
        return removed

    def analyze(self) -> None:
        """Row counts and column statistics for the optimizer, after bulk loads."""
        self.spark.sql(f"ANALYZE TABLE {self.files_table} COMPUTE STATISTICS FOR ALL COLUMNS")


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest first; equal times by id, so the listing is repeatable."""
    return snapshots.orderBy(F.col("taken_at").desc(), F.col("id").desc())


def without_snapshot(files: DataFrame, snapshots: DataFrame, name: str) -> DataFrame:
    """File rows that stay when the named snapshot goes (for tables outside a catalog).

    Should the registry hold a name twice, the rows of every id of that name go.
    """
    doomed = snapshots.filter(F.col("name") == name).select(F.col("id").alias("snapshot_id"))
    return files.join(doomed, "snapshot_id", "left_anti")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
