"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.functions import paths, values
from driftledger.model import FILE_SCHEMA, DiffOptions, Rule, ScanOptions, WatchOptions
from driftledger.operators import diff as diffs
from driftledger.operators import enrich, events, ingest, manifest, ranking, report, rules, selection
from driftledger.operators.throttle import throttle
from driftledger.plans.compare import diff, diff_snapshots
from driftledger.plans.compare import diff_summary as diff_counts
from driftledger.plans.monitor import replay, watch
from driftledger.plans.scan import ingest_snapshot
from driftledger.sources import filehash, journal, rulefile, store
from driftledger.sources.workdir import fresh_path
from driftledger.streaming import runner

from . import derive

Query = Callable[[SparkSession, str], DataFrame]

HOUR_MS = 3_600_000
NO_OPTIONS = DiffOptions()
NOISE = (Rule("prefix", "c:/noise/"), Rule("prefix", "D:\\Noise"))
GLOBS = (Rule("glob", "?:\\dir[0-2]\\**"), Rule("glob", "**/*.{tmp,pyd}"))
REGEXES = (Rule("regex", r"C:\Noise\.*"), Rule("regex", r".*\\dir[56]\\f\d*7\.log"))

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


# diff


@query
def diff_modified(spark, d):
    return diffs.modified(*derive.documents_pair(spark, d), NO_OPTIONS)


@query
def diff_added(spark, d):
    return diffs.added(*derive.documents_pair(spark, d), NO_OPTIONS)


@query
def diff_removed(spark, d):
    return diffs.removed(*derive.documents_pair(spark, d), NO_OPTIONS)


@query
def diff_replaced(spark, d):
    return diffs.replaced(*derive.documents_pair(spark, d), NO_OPTIONS)


@query
def diff_all(spark, d):
    return diff(*derive.documents_pair(spark, d))


@query
def diff_full_outer(spark, d):
    return diffs.frn_changes(*derive.documents_pair(spark, d), NO_OPTIONS)


@query
def diff_summary(spark, d):
    return diff_counts(*derive.documents_pair(spark, d))


@query
def diff_report_summary(spark, d):
    """The same counts taken from the finished report."""
    return diffs.summary(diff(*derive.documents_pair(spark, d)))


@query
def diff_limit(spark, d):
    return diff(*derive.documents_pair(spark, d), DiffOptions(limit=25))


@query
def diff_include_dirs(spark, d):
    return diff(*derive.documents_pair(spark, d), DiffOptions(include_dirs=True))


@query
def diff_ext_pe(spark, d):
    return diff(*derive.documents_pair(spark, d), DiffOptions(extensions=(" .PE", "Txt", ".")))


@query
def diff_excluded(spark, d):
    return diff(*derive.documents_pair(spark, d), DiffOptions(rules=NOISE))


@query
def diff_hidden_paths(spark, d):
    options = DiffOptions(hidden_paths=("C:\\dir3\\", "D:/DIR4"), limit=40)
    return diff(*derive.documents_pair(spark, d), options)


@query
def diff_inventory(spark, d):
    """The large pair: every lineitem key is a file."""
    return diff(*derive.lineitem_pair(spark, d), sift=True)


@query
def diff_inventory_summary(spark, d):
    return diff_counts(*derive.lineitem_pair(spark, d), DiffOptions(rules=NOISE))


@query
def report_json(spark, d):
    return report.report_json(diff(*derive.documents_pair(spark, d)))


# rules


def _excluded(spark, d, rule_list):
    compiled = rules.compile_rules(rule_list)
    files = derive.documents_all(spark, d)
    return files.filter(compiled.excludes(F.col("path"))).select("snapshot_id", "volume", "frn", "path")


@query
def rule_prefix(spark, d):
    return _excluded(spark, d, NOISE)


@query
def rule_prefix_many(spark, d):
    many = [Rule("prefix", f"{v}:\\DIR{n}") for v in "CDEFGHIJKLMN" for n in range(5)]
    return _excluded(spark, d, many + [Rule("prefix", ""), Rule("prefix", "c:\\noise")])


@query
def rule_glob(spark, d):
    return _excluded(spark, d, GLOBS)


@query
def rule_regex(spark, d):
    return _excluded(spark, d, REGEXES)


@query
def rule_any(spark, d):
    return _excluded(spark, d, NOISE + GLOBS + REGEXES)


@query
def rule_list(spark, d):
    """Rules collected from many places: exact repeats go, order stays, variables expand."""
    rows = derive.table(spark, d, "part").select(
        F.col("p_partkey").cast("int").alias("pos"),
        F.when(F.col("p_size") % 2 == 0, F.lit("prefix")).otherwise(F.lit("glob")).alias("kind"),
        F.concat(F.lit("%LOCALAPPDATA%\\"), "p_brand").alias("pattern"),
    )
    return rules.list_rules(rules.distinct_rules(rows), {"LOCALAPPDATA": "C:\\Users\\me"})


@query
def rules_roundtrip(spark, d):
    """Collected rules edited by position and by addition, saved to a rules file and read back."""
    rows = derive.table(spark, d, "part").select(
        F.col("p_partkey").cast("int").alias("pos"),
        F.when(F.col("p_size") % 2 == 0, F.lit("prefix")).otherwise(F.lit("glob")).alias("kind"),
        F.concat(F.lit("%LOCALAPPDATA%\\"), "p_brand").alias("pattern"),
    )
    edited = rules.add_rule(rules.remove_rule(rules.distinct_rules(rows), "2"), "glob", "*.swp")
    path = fresh_path(spark, "rules")
    rulefile.write_rules(spark, rules.rules_from(edited), path)
    return rules.list_rules(rulefile.read_rules(spark, path), {"LOCALAPPDATA": "C:\\Users\\me"})


@query
def rule_expand(spark, d):
    """Per-host expansion: every host brings its own value."""
    pattern = F.concat(F.lit("${LOCALAPPDATA}\\m"), F.col("c_mktsegment"), F.lit("\\%LOCALAPPDATA%"))
    host = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("C:\\Users\\"), "c_name"))
    return derive.table(spark, d, "customer").select(
        "c_custkey", rules.expand_variables_column(pattern, host).alias("expanded")
    )


# ingest, volumes, registry


@query
def ingest_upsert(spark, d):
    return ingest.latest_records(derive.scan_records(spark, d)).select(
        "volume", "frn", "path", "size", "mtime", "seq"
    )


@query
def ingest_inventory(spark, d):
    compiled = rules.compile_rules([Rule("prefix", "C:\\Noise"), Rule("glob", "*.log")])
    rows = ingest.inventory_rows(derive.scan_records(spark, d), 7, compiled)
    return rows.select("snapshot_id", "volume", "frn", "parent_frn", "path", "name", "size", "mtime", "ctime", "is_dir", "sha256", "digest2")


@query
def ingest_stats(spark, d):
    compiled = rules.compile_rules([Rule("prefix", "C:\\Noise"), Rule("glob", "*.log")])
    return selection.scan_stats(derive.scan_records(spark, d), compiled)


@query
def volume_filter(spark, d):
    chosen = selection.filter_volumes(derive.scan_records(spark, d), (" c:\\ ", "E", "Z"), ("e:",))
    return chosen.groupBy("volume").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query
def volume_list(spark, d):
    return selection.volume_counts(derive.month_files(spark, d))


@query
def snapshot_list(spark, d):
    return store.list_snapshots(derive.month_snapshots(spark, d))


@query
def snapshot_delete(spark, d):
    return store.without_snapshot(
        derive.month_files(spark, d), derive.month_snapshots(spark, d), "scan-1998-03"
    )


def _new_store(spark, label):
    """An empty store in a database of its own, below the shared work folder."""
    name = f"{label}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, label)}'")
    return store.SnapshotStore(spark, name).create()


@query
def scan_store(spark, d):
    """Two scans into a store, the second one deleted again: the first one's rows are all there."""
    own, records = _new_store(spark, "scan_store"), derive.scan_records(spark, d)
    options = ScanOptions(rules=(Rule("prefix", "C:\\Noise"), Rule("glob", "*.log")))
    ingest_snapshot(own, records, "first", options, snapshot_id=7)
    ingest_snapshot(own, records, "second", snapshot_id=8)
    own.delete("second")
    return own.files().select("snapshot_id", "volume", "frn", "parent_frn", "path", "name", "size", "mtime", "ctime", "is_dir", "sha256", "digest2")


@query
def store_diff(spark, d):
    """Two stored snapshots found by name and compared, next to a third that comes and goes."""
    own = _new_store(spark, "store_diff")
    for number, (name, rows) in enumerate(zip(("before", "after"), derive.documents_pair(spark, d)), 1):
        rows = rows.withColumn("snapshot_id", F.lit(number).cast("long"))
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in FILE_SCHEMA if f.name not in rows.columns]
        own.write_files(rows.select("*", *missing), number)
        own.register(name, number, taken_at=number)
    ingest_snapshot(own, derive.scan_records(spark, d), "other", snapshot_id=3)
    own.delete("other")
    return diff_snapshots(own, "before", "after")


# enrichment


@query
def hash_candidates(spark, d):
    return derive.documents_to_hash(spark, d).filter(enrich.hash_candidate()).select("volume", "frn", "size")


@query
def hash_enrich(spark, d):
    rows = enrich.enrich_files(
        derive.documents_to_hash(spark, d), derive.documents_content(spark, d), "sha512"
    )
    return rows.select(
        "volume", "frn", "path", "outcome", "sha256", F.length("digest2").alias("digest2_length")
    )


@query
def hash_files(spark, d):
    """Digests of real files, read chunk by chunk where they lie."""
    rows, root = derive.document_files(spark, d)
    found = filehash.hash_files(rows, {"D:": root}, "sha512")
    return found.select(
        "volume", "frn", "path", "outcome", "sha256", F.length("digest2").alias("digest2_length"), "bytes_read"
    )


@query
def tree_files(spark, d):
    """The same files found by walking their folder: names, sizes, nothing left out."""
    _, root = derive.document_files(spark, d)
    return filehash.read_tree(spark, root, "D:").where("not is_dir").select("volume", "path", "name", "size")


@query
def hash_stats(spark, d):
    return enrich.hash_stats(
        enrich.with_outcome(derive.documents_to_hash(spark, d), derive.documents_digests(spark, d))
    )


@query
def digest_write_back(spark, d):
    digests = derive.documents_before(spark, d).filter(F.col("sha256").isNotNull()).select(
        F.lit(1).cast("long").alias("snapshot_id"), "volume", "frn", "sha256",
        F.lit(None).cast("string").alias("digest2"),
    )
    return enrich.write_back_digests(derive.documents_to_hash(spark, d), digests).select(
        "volume", "frn", "path", "sha256"
    )


@query
def same_hash_across(spark, d):
    return enrich.same_hash_groups(derive.documents_all(spark, d))


@query
def same_hash_files(spark, d):
    return enrich.same_hash_files(derive.month_files(spark, d))


# expressions


@query
def path_ext(spark, d):
    files = derive.documents_all(spark, d)
    p = F.col("path")
    return files.select(
        "snapshot_id", "volume", "frn",
        paths.name_extension(p).alias("name_ext"),
        paths.path_extension(p).alias("path_ext"),
        paths.basename(p).alias("base"),
        paths.has_pe_path_extension(p).alias("pe"),
        paths.normalize_prefix(p).alias("prefix_form"),
    )


@query
def path_names(spark, d):
    """Name expressions on web addresses: both separators, dots and empty last components."""
    u = F.translate(F.col("url"), "=", "\\")
    return derive.table(spark, d, "pages").select(
        "page_id",
        paths.name_extension(u).alias("name_ext"),
        paths.path_extension(u).alias("path_ext"),
        paths.basename(u).alias("base"),
    )


@query
def path_normalize(spark, d):
    e = F.col("event_id")
    below = F.concat(F.lit("\\u"), F.col("user_id").cast("string"), F.lit("\\f.exe"))
    raw = (
        F.when(e % 6 == 0, F.concat(F.lit("\\\\?\\x:"), below))
        .when(e % 6 == 1, F.concat(F.lit("\\\\.\\X:"), below))
        .when(e % 6 == 2, below)
        .when(e % 6 == 3, F.substring(below, 2, 1000))
        .when(e % 6 == 4, F.concat(F.lit("\\\\?\\D:"), below))
        .otherwise(F.concat(F.lit("\\\\?\\Volume{f083}"), below))
    )
    mount = F.when(e % 7 != 0, F.lit("X:\\"))
    return derive.table(spark, d, "events").select(
        "event_id",
        paths.record_path(raw, mount).alias("path"),
        paths.volume_label(mount, F.lit("\\\\?\\Volume{f083}\\")).alias("label"),
    )


@query
def frn_unsigned(spark, d):
    k = F.col("o_orderkey")
    frn = F.when(k % 2 == 0, -k - 1).otherwise(k)
    return derive.table(spark, d, "orders").select(
        "o_orderkey",
        values.unsigned_id(frn).cast("string").alias("shown"),
        values.signed_id(values.unsigned_id(frn)).alias("stored"),
    )


@query
def clock_values(spark, d):
    ts = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    return derive.table(spark, d, "events").select(
        "event_id",
        values.unix_or_zero(ts).alias("unix"),
        values.clock_text(values.unix_or_zero(ts)).alias("clock"),
    )


@query
def digest_values(spark, d):
    return derive.table(spark, d, "documents").select(
        "doc_id",
        values.hex_lower(F.encode("text", "UTF-8")).alias("hex"),
        values.sha256_hex(F.encode("text", "UTF-8")).alias("sha256"),
    )


@query
def prefix_forms(spark, d):
    """Separators of both kinds, and none to three of them at the end."""
    k = F.col("page_id") % 4
    tail = F.when(k == 1, F.lit("/")).when(k == 2, F.lit("\\/")).when(k == 3, F.lit("//\\")).otherwise(F.lit(""))
    path = F.concat(F.replace("url", F.lit("="), F.lit("\\")), tail)
    return derive.table(spark, d, "pages").select("page_id", paths.normalize_prefix(path).alias("prefix_form"))


# change records


def _flat(df: DataFrame) -> DataFrame:
    extra = [c for c in ("renamed_from", "sha256_hex", "size") if c in df.columns]
    return df.select("usn", F.unix_micros("ts").alias("us"), "volume", "frn", "kind", "path", *extra)


@query
def event_classify(spark, d):
    prepared = events.prepare_records(derive.records(spark, d), WatchOptions())
    return events.classify_events(prepared).select(
        "usn", "kind", "path", values.event_tag(F.col("kind")).alias("tag")
    )


@query
def event_rename(spark, d):
    prepared = events.prepare_records(derive.records(spark, d), WatchOptions())
    return _flat(events.pair_renames(prepared, piece=5000))


@query
def event_emit(spark, d):
    options = WatchOptions(rules=(Rule("regex", r"C:\u1\.*"),), extensions=("pe",), volumes=("c",))
    prepared = events.prepare_records(derive.records(spark, d), options)
    return _flat(events.emitted(events.classify_events(prepared), rules.path_filter(options)))


@query
def event_throttle(spark, d):
    return _flat(replay(derive.records(spark, d), WatchOptions(window_ms=HOUR_MS)))


@query
def event_throttle_hot(spark, d):
    """The throttle alone on five hot keys, so that chains run through many spans."""
    rows = derive.table(spark, d, "events").select(
        F.col("event_id").alias("usn"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit("C:").alias("volume"), F.col("user_id").alias("frn"),
        F.col("event_type").alias("kind"), F.lit("C:\\all").alias("path"),
    )
    return _flat(throttle(rows, HOUR_MS, windows_per_span=8))


@query
def event_enrich(spark, d):
    found = replay(derive.records(spark, d), WatchOptions(window_ms=HOUR_MS))
    digests = events.event_digests(derive.event_content(spark, d))
    return _flat(events.enrich_events(found, digests))


@query
def event_stream(spark, d):
    """The watch as a stream over the same records, driven to its end."""
    schema = derive.table(spark, d, "events").schema
    source = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    )
    out = fresh_path(spark, "event-stream")
    found = _flat(watch(derive.change_records(source), WatchOptions(window_ms=HOUR_MS)))
    running = (
        found.writeStream.format("parquet")
        .option("path", os.path.join(out, "rows"))
        .option("checkpointLocation", os.path.join(out, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(os.path.join(out, "rows"))


@query
def event_stream_unordered(spark, d):
    """The watch over records that arrive out of order, in several micro-batches: late by up to two days.

    Two last files hold one record each, far in the future, that is no event: they move the clock on.
    """
    rows = derive.records(spark, d)
    folder = fresh_path(spark, "unordered")
    day = F.floor(F.unix_seconds("ts") / 86400)
    late = F.pmod(F.xxhash64("usn"), F.lit(3))
    first, last = rows.agg(F.min(day), F.max(day)).first()
    # a record comes with its own two days, or with the next ones
    turn = F.floor((day + F.when(late == 0, 2).otherwise(0) - first) / F.lit(max(1, (last - first) // 3)))
    numbered = rows.withColumn("turn", F.least(turn, F.lit(3)))
    for k in range(4):
        part = numbered.where(F.col("turn") == k).drop("turn").repartition(1, F.xxhash64("usn"))
        part.write.mode("append").parquet(folder)
    ending = rows.limit(1).withColumns({"reason": F.lit(0).cast("long"), "ts": F.lit("2200-01-01").cast("timestamp")})
    for _ in range(2):
        ending.coalesce(1).write.mode("append").parquet(folder)
    out = fresh_path(spark, "event-stream")
    source = journal.stream_records(spark, folder, max_files_per_trigger=1)
    found = _flat(watch(source, WatchOptions(window_ms=HOUR_MS), lateness="3 days"))
    running = (
        found.writeStream.format("parquet")
        .option("path", os.path.join(out, "rows"))
        .option("checkpointLocation", os.path.join(out, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(os.path.join(out, "rows"))


@query
def event_jsonl(spark, d):
    """Two record streams merged into one watch; its JSON lines read back."""
    schema = derive.table(spark, d, "events").schema

    def half(k):
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        return derive.change_records(source.where(F.col("event_id") % 2 == k))

    out = fresh_path(spark, "event-jsonl")
    rows, checkpoint = os.path.join(out, "rows"), os.path.join(out, "checkpoint")
    found = watch(journal.union_volumes([half(0), half(1)]), WatchOptions(window_ms=HOUR_MS))
    runner.write_events(found, rows, checkpoint, available_now=True).awaitTermination()
    line = "timestamp long, volume string, kind string, path string, renamed_from string, sha256_hex string, size long"
    return spark.read.schema(line).json(rows)


# triage


@query
def triage_manifest(spark, d):
    changes = diff(*derive.documents_pair(spark, d))
    rows = manifest.manifest(changes, derive.documents_digests(spark, d))
    return rows.withColumnRenamed("category_rank", "cat").select(
        "cat", "side", "kind", "original_path", "volume", "frn", "size", "mtime", "sha256_hex", "target_name"
    )


@query
def triage_order(spark, d):
    """Place of every manifest row in the report: the two sides of a change follow each other."""
    changes = diff(*derive.documents_pair(spark, d))
    rows = manifest.manifest(changes, derive.documents_digests(spark, d)).withColumn("report", F.lit(1))
    placed = ranking.rank_in_groups(rows, ["report"], list(manifest.ORDER), "place")
    return placed.select("place", F.col("category_rank").alias("cat"), "side", "volume", "frn", "original_path")


@query
def triage_stream(spark, d):
    """Bytes collected by a watch in several micro-batches, each name once over all of them."""
    content = derive.event_content(spark, d)
    folder, out = fresh_path(spark, "records"), fresh_path(spark, "triage")
    rows = derive.records(spark, d)
    low, high = rows.agg(F.min("usn"), F.max("usn")).first()
    turn = F.floor((F.col("usn") - low) * 4 / (high - low + 1))
    for k in range(4):
        rows.where(turn == k).coalesce(1).write.mode("append").parquet(folder)
    found = watch(journal.stream_records(spark, folder, max_files_per_trigger=1), WatchOptions(window_ms=HOUR_MS))
    runner.write_events_with_triage(
        found, lambda wanted: content, out, os.path.join(out, "checkpoint"), available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/files").select(
        "target_name", F.length("content").cast("long").alias("n_bytes"), values.sha256_hex(F.col("content")).alias("sha256")
    )


@query
def manifest_events(spark, d):
    found = replay(derive.records(spark, d), WatchOptions(window_ms=HOUR_MS))
    digests = events.event_digests(derive.event_content(spark, d))
    return manifest.event_manifest(events.enrich_events(found, digests))


@query
def triage_content(spark, d):
    """Bytes of every hashed event file, once per name."""
    content = derive.event_content(spark, d)
    found = replay(derive.records(spark, d), WatchOptions(window_ms=HOUR_MS))
    rows = manifest.event_manifest(events.enrich_events(found, events.event_digests(content)))
    kept = manifest.collect_content(rows.withColumnRenamed("dumped_to", "target_name"), content)
    return kept.select(
        "target_name", F.length("content").cast("long").alias("n_bytes"),
        values.sha256_hex(F.col("content")).alias("sha256"),
    )
