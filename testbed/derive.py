"""Deterministic inventories, contents and change records over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.operators import enrich, ingest
from driftledger.sources.workdir import fresh_path, stored

BS = "\\"
# Extension by doc_id % 8
DOC_EXT = (".exe", ".dll", ".TXT", ".DLL", ".log", "", ".pyd", ".tmp")
EVENT_EXT = (".exe", ".DLL", ".log", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# Snapshot pair from documents


def doc_volume(d: Column) -> Column:
    return F.when(F.floor(d / 20) % 3 == 0, F.lit("D:")).otherwise(F.lit("C:"))


def doc_dir(d: Column) -> Column:
    return (
        F.when((d % 20).isin(11, 13), F.lit("Noise"))
        .when(d % 20 == 14, F.lit("NoiseButReal"))
        .otherwise(_text("dir", d % 7))
    )


def doc_path(d: Column) -> Column:
    return _text(doc_volume(d), BS, doc_dir(d), BS, "f", d, _pick(d % 8, DOC_EXT))


def _doc_hash(text: Column, d: Column) -> Column:
    hashed = (d % 11 != 0) & (d % 8).isin(0, 1, 3, 6)
    return F.when(hashed, F.sha2(text, 256))


def documents_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc_volume(d).alias("volume"),
        (d + 1000).alias("frn"),
        doc_path(d).alias("path"),
        F.col("n_chars").alias("size"),
        (F.lit(1700000000) + d * 60).alias("mtime"),
        (d % 11 == 0).alias("is_dir"),
        _doc_hash(F.col("text"), d).alias("sha256"),
    )


def documents_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = F.col("doc_id"), F.col("doc_id") % 20
    extra = F.col("extra")
    changed = m.isin(1, 4, 13, 14)
    path = doc_path(d)
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").filter(m != 0).withColumn(
        "extra", F.explode(F.when(m == 12, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    return rows.select(
        doc_volume(d).alias("volume"),
        F.when(extra, d + 20001000).when(m == 5, d + 10001000).otherwise(d + 1000).alias("frn"),
        F.when(extra, F.concat(path, F.lit(".new.dll")))
        .when(m.isin(3, 4), F.concat(path, F.lit(".bak")))
        .when(m == 6, F.upper(path))
        .when(m == 9, doc_path(d + 1))
        .when(m == 10, doc_path(d - 1))
        .when(m == 11, F.replace(path, F.lit("Noise"), F.lit("Work")))
        .otherwise(path)
        .alias("path"),
        F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"),
        (
            F.lit(1700000000) + d * 60
            + F.when(extra, F.lit(200)).when(changed | (m == 2), F.lit(100)).otherwise(F.lit(0))
        ).alias("mtime"),
        F.when(extra, F.lit(False)).when(m == 7, d % 11 != 0).otherwise(d % 11 == 0).alias("is_dir"),
        F.when(extra, F.sha2(F.concat(text, F.lit("#")), 256))
        .when(m == 8, F.lit(None))
        .when(changed, _doc_hash(F.concat(text, F.lit("!")), d))
        .otherwise(_doc_hash(text, d))
        .alias("sha256"),
    )


def documents_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return documents_before(spark, sf_dir), documents_after(spark, sf_dir)


def documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots in one inventory, before = 1 and after = 2."""
    before, after = documents_pair(spark, sf_dir)
    return before.withColumn("snapshot_id", F.lit(1).cast("long")).unionByName(
        after.withColumn("snapshot_id", F.lit(2).cast("long"))
    )


# Content for the documents inventory: some start with MZ, some cannot be read


def documents_to_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.lit(1).cast("long").alias("snapshot_id"),
        doc_volume(d).alias("volume"),
        (d + 1000).alias("frn"),
        doc_path(d).alias("path"),
        F.when(d % 29 == 0, F.lit(0)).when(d % 31 == 0, F.lit(209715201))
        .otherwise(F.col("n_chars")).cast("long").alias("size"),
        (d % 11 == 0).alias("is_dir"),
        F.when(d % 13 == 0, F.lit("stale")).alias("sha256"),
        F.lit(None).cast("string").alias("digest2"),
    )


def documents_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 17 == 0, F.concat(F.lit("MZ"), F.col("text"))).otherwise(F.col("text"))
    content = F.encode(text, "UTF-8")
    return table(spark, sf_dir, "documents").filter(d % 23 != 0).select(
        doc_volume(d).alias("volume"),
        doc_path(d).alias("path"),
        F.length(content).cast("long").alias("length"),
        content.alias("content"),
    )


# Scan records and a large snapshot pair from lineitem; repeated keys exercise the upsert


def _scan_name() -> Column:
    ext = _pick(F.col("l_partkey") % 6, (".exe", ".dll", ".TXT", ".log", "", ".sys"))
    return _text("p", F.col("l_partkey"), ext)


def _scan_path(volume: Column, frn: Column) -> Column:
    folder = _pick(F.col("l_partkey") % 5, ("Windows", "Users", "Noise", "NoiseButReal", "Temp"))
    return _text(volume, BS, folder, BS, "d", frn, BS, _scan_name())


def _scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan records, and the part their names and paths are made from."""
    frn = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    volume = _text(_pick(F.col("l_orderkey") % 4, ("C", "D", "E", "c")), ":")
    seq = F.col("l_partkey") * F.lit(10_000_000_000) + F.round(F.col("l_extendedprice") * 100).cast("long")
    lost = (F.col("l_partkey") + F.col("l_suppkey")) % 37 == 0
    return table(spark, sf_dir, "lineitem").select(
        volume.alias("volume"),
        frn.alias("frn"),
        F.col("l_orderkey").alias("parent_frn"),
        F.when(lost, F.lit("")).otherwise(_scan_path(volume, frn)).alias("path"),
        _scan_name().alias("name"),
        F.col("l_quantity").cast("long").alias("size"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("mtime"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ctime"),
        F.lit(False).alias("is_dir"),
        seq.alias("seq"),
        "l_partkey",
    )


def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_rows(spark, sf_dir).drop("l_partkey")


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """About 2 % of all files in each of several kinds of change.

    The upserted inventory is written once, as a scan would, and read back for both sides. The upsert moves
    numbers; names and paths are made of the rows that stay.
    """
    rows = _scan_rows(spark, sf_dir).filter(F.col("path") != "").select("volume", "frn", "l_partkey", "size", "mtime", "seq")
    named = ingest.latest_records(rows).withColumns(
        {"path": _scan_path(F.col("volume"), F.col("frn")), "name": _scan_name(), "is_dir": F.lit(False)}
    )
    base = named.withColumn(
        "sha256",
        F.when(F.col("name").rlike("(exe|dll|sys)$"), F.sha2(F.concat("name", F.col("size").cast("string")), 256)),
    ).select("volume", "frn", "path", "size", "mtime", "is_dir", "sha256")
    base = stored(base, "inventory")
    m = F.col("frn") % 50
    after = base.filter(m != 0).select(
        "volume",
        F.when(m == 3, F.col("frn") + 1_000_000_000).otherwise(F.col("frn")).alias("frn"),
        F.when(m == 2, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"),
        F.when(m.isin(1, 4), F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(m.isin(1, 4, 5), F.col("mtime") + 100).otherwise(F.col("mtime")).alias("mtime"),
        "is_dir",
        F.when((m == 1) & F.col("sha256").isNotNull(), F.sha2(F.col("path"), 256))
        .otherwise(F.col("sha256")).alias("sha256"),
    )
    return base, after


# Registry and inventory of many snapshots from orders: one snapshot per month


def month_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(month.alias("month"))
        .agg(
            F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("taken_at"),
            F.max("o_custkey").alias("top"),
        )
        .select(
            F.replace("month", F.lit("-"), F.lit("")).cast("long").alias("id"),
            F.concat(F.lit("scan-"), "month").alias("name"),
            "taken_at",
            F.when(F.col("top") % 2 == 0, F.concat(F.lit("HOST"), F.col("top").cast("string"))).alias("host"),
            F.lit(None).cast("string").alias("note"),
        )
    )


def month_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.replace(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-"), F.lit("")).cast("long").alias("snapshot_id"),
        _text(_pick(k % 3, ("C", "D", "E")), ":").alias("volume"),
        k.alias("frn"),
        _text("C:", BS, "o", F.col("o_custkey"), BS, k, ".exe").alias("path"),
        F.when(k % 3 != 0, F.sha2(_text("h", F.col("o_custkey")), 256)).alias("sha256"),
    )


# Change records from events


def event_path(user: Column, event: Column) -> Column:
    return _text("C:", BS, "u", user % 20, BS, "f", event % 3, _pick(event % 4, EVENT_EXT))


def change_records(events: DataFrame) -> DataFrame:
    """Works on the batch table and on a stream of it."""
    e, kind = F.col("event_id"), F.col("event_type")
    path = event_path(F.col("user_id"), e)
    close = 0x80000000

    def record(step: int, reason: int, p: Column = path) -> Column:
        return F.struct(
            (e * 10 + step).alias("usn"), F.lit(reason).cast("long").alias("reason"), p.alias("path")
        )

    click = F.when(e % 2 == 1, F.array(record(1, close | 0x8000))).otherwise(F.array(record(1, 0x2)))
    late_old = F.when(e % 5 == 0, F.array(record(2, close | 0x1100))).otherwise(F.slice(F.array(record(2, 0)), 1, 0))
    records = (
        F.when(kind == "signup", F.array(record(1, close | 0x100)))
        .when(kind == "purchase", F.array(record(1, close | 0x8002)))
        .when(kind == "error", F.array(record(1, close | 0x200)))
        .when(kind == "view", F.array(record(0, 0x1000, F.concat(path, F.lit(".old"))), record(1, close | 0x2000)))
        .otherwise(F.concat(click, late_old))
    )
    return events.withColumn("r", F.explode(records)).select(
        F.col("r.usn").alias("usn"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("C:").alias("volume"),
        F.col("user_id").alias("frn"),
        F.col("r.reason").alias("reason"),
        F.col("r.path").alias("path"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_records(table(spark, sf_dir, "events"))


def event_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for nearly every path events touch; log files start with MZ."""
    path = event_path(F.col("user_id"), F.col("event_id"))
    text = F.when(F.endswith("path", F.lit(".log")), F.concat(F.lit("MZ"), "path")).otherwise(F.col("path"))
    content = F.encode(text, "UTF-8")
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("user_id") % 20 != 7)
        .select(path.alias("path"))
        .distinct()
        .select(
            F.lit("C:").alias("volume"), "path",
            F.length(content).cast("long").alias("length"), content.alias("content"),
        )
    )


def document_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Inventory of files that lie below a folder, one per document, and that folder.

    Some are empty, cannot be found, begin with a dot or an underscore, or start with MZ. Every task writes
    the files of its rows.
    """
    root = fresh_path(spark, "files")
    d = F.col("doc_id")
    mark = F.when(d % 9 == 0, F.lit("_")).when(d % 10 == 0, F.lit(".")).otherwise(F.lit(""))
    path = _text("D:", BS, "dir", d % 7, BS, mark, "f", d, _pick(d % 8, DOC_EXT))
    body = F.when(d % 29 == 0, F.lit("")).when(d % 17 == 0, F.concat(F.lit("MZ"), "text")).otherwise(F.col("text"))
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        F.lit(1).cast("long").alias("snapshot_id"), F.lit("D:").alias("volume"), (d + 1000).alias("frn"), path.alias("path"),
        F.length(body).cast("long").alias("size"), (d % 11 == 0).alias("is_dir"),
        F.when(d % 13 == 0, F.lit("stale")).alias("sha256"), F.lit(None).cast("string").alias("digest2"),
    )
    written = table(spark, sf_dir, "documents").where(d % 23 != 0).select(path.alias("path"), body.alias("body"))

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["body"]):
                target = os.path.join(root, *name.split(BS)[1:])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as out:
                    out.write(content)
            yield batch[["path"]].head(0)

    written.mapInPandas(write, "path string").count()
    return rows, root


def documents_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.content_digests(documents_content(spark, sf_dir))
