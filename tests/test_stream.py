import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftledger import WatchOptions, replay, watch
from driftledger.model import CHANGE_RECORD_SCHEMA, FLEET_RECORD_SCHEMA
from driftledger.sources.journal import read_records, stream_records, union_volumes
from driftledger.streaming.runner import (
    await_sources,
    write_events,
    write_events_with_triage,
)
from driftledger.streaming.stateful import stretches, ttl_millis
from testbed import derive

WINDOW = WatchOptions(window_ms=3_600_000)


@pytest.fixture(scope="module")
def journal(spark, tmp_path_factory):
    """Derived records in several files; each file later in time than the one before."""
    path = tmp_path_factory.mktemp("journal")
    records = derive.records(spark, "/root/testdata/sf0.001")
    edges = [0, 3000, 6000, 1 << 60]
    for low, high in zip(edges, edges[1:]):
        part = records.filter((F.col("usn") >= low) & (F.col("usn") < high)).coalesce(1)
        part.write.mode("append").parquet(str(path))
    return str(path)


def lines(path):
    return sorted(
        json.dumps(json.loads(line), sort_keys=True)
        for f in path.rglob("*.json") for line in f.read_text().splitlines()
    )


def key(r):
    return (r["timestamp"], r["volume"], r["kind"], r["path"], r["renamed_from"])


def expected(spark, journal):
    rows = replay(read_records(spark, journal), WINDOW).collect()
    return sorted((int(r.ts.timestamp()), r.volume, r.kind, r.path, r.renamed_from or "") for r in rows)


def test_stream_equals_replay_over_batches(spark, journal, tmp_path):
    source = stream_records(spark, journal, max_files_per_trigger=1)
    query = write_events(watch(source, WINDOW), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(150)
    assert query.lastProgress.batchId == 2
    got = [json.loads(x) for x in lines(tmp_path / "out")]
    assert sorted((*key(r)[:4], r["renamed_from"] or "") for r in got) == expected(spark, journal)
    assert all(r["size"] is None and r["sha256_hex"] is None for r in got)


def test_triage_batches_and_tolerated_source(spark, journal, tmp_path):
    content = derive.event_content(spark, "/root/testdata/sf0.001")
    source = union_volumes([stream_records(spark, journal)])
    query = write_events_with_triage(
        watch(source, WINDOW), lambda wanted: content, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    broken = (
        spark.readStream.schema("value string").text(journal).select(F.raise_error(F.lit("bad")).cast("string").alias("value"))
        .writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    errors = await_sources([query, broken])
    assert len(errors) == 1
    with pytest.raises(RuntimeError, match="all watch sources failed"):
        await_sources([broken])
    events = [json.loads(x) for x in lines(tmp_path / "out" / "events")]
    assert sorted((*key(r)[:4], r["renamed_from"] or "") for r in events) == expected(spark, journal)
    hashed = [r for r in events if r["sha256_hex"]]
    assert hashed and all(r["kind"] != "Deleted" for r in hashed)
    manifest = [json.loads(x) for x in lines(tmp_path / "out" / "manifest")]
    assert len(manifest) == len(hashed)
    files = spark.read.parquet(str(tmp_path / "out" / "files"))
    assert files.select("target_name").distinct().count() == len({r["dumped_to"] for r in manifest})


def test_late_records_and_hosts_are_kept(spark, tmp_path):
    """Two hosts share path and id; the second file is hours older than the first."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)

    def rows(first, *hours):
        return [
            (first + n, start + datetime.timedelta(hours=h), "C:", 7, 0x80000002, "C:\\\\x.exe", host)
            for n, h in enumerate(hours) for host in ("h1", "h2")
        ]

    path = str(tmp_path / "in")
    for part in (rows(1, 10, 10.5), rows(5, 2, 2.5, 9.5, 10.25)):
        spark.createDataFrame(part, FLEET_RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = stream_records(spark, path, max_files_per_trigger=1, schema=FLEET_RECORD_SCHEMA)
    query = write_events(watch(source, WINDOW), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(150)
    got = sorted((r["host"], (r["timestamp"] - start.timestamp()) / 3600) for r in map(json.loads, lines(tmp_path / "out")))
    # 9.5 and 10.25 lie inside the window around the emission at 10, 2.5 inside that of 2
    assert got == [(h, t) for h in ("h1", "h2") for t in (2, 10)]
    batch = replay(read_records(spark, path, FLEET_RECORD_SCHEMA), WINDOW).collect()
    assert sorted((r.host, (r.ts - start.replace(tzinfo=None)).total_seconds() / 3600) for r in batch) == [
        (h, t) for h in ("h1", "h2") for t in (2, 9.5, 10.5)]


def test_held_records_share_calls(spark, tmp_path):
    """Two thousand files out of order: what waits is a few chunks, and the stream equals the replay."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    close, old, new = 0x80000000, 0x1000, 0x2000

    def rows(files, hours):
        for n in files:
            at = start + datetime.timedelta(hours=hours + n % 7, seconds=n)
            frn = (1 << 60) + n
            yield 10 * n, at, "C:", frn, old, f"C:\\old{n}", "h"
            yield 10 * n + 1, at, "C:", frn, close | new, f"C:\\new{n}", "h"
            yield 10 * n + 2, at, "C:", frn, close | 2, f"C:\\new{n}", "h"

    path = str(tmp_path / "in")
    clock = [(99_999, start + datetime.timedelta(days=9), "C:", 1, 0, "C:\\none", "h")]
    for part in (rows(range(0, 2000, 2), 8), rows(range(1, 2000, 2), 2), clock, clock):
        spark.createDataFrame([*part], FLEET_RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = stream_records(spark, path, max_files_per_trigger=1, schema=FLEET_RECORD_SCHEMA)
    found = watch(source, WINDOW, lateness="1 day")
    query = write_events(found, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(150)
    got = sorted((*key(r)[:4], r["renamed_from"] or "") for r in map(json.loads, lines(tmp_path / "out")))
    batch = replay(read_records(spark, path, FLEET_RECORD_SCHEMA), WINDOW).collect()
    assert got == sorted((int(r.ts.timestamp()), r.volume, r.kind, r.path, r.renamed_from or "") for r in batch)
    assert len(got) == 4000 and sum(r[4] != "" for r in got) == 2000
    timers = [op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators]
    # four buckets for each of four partitions, in a few stretches of time, for renames and for the others
    assert 0 < max(timers) <= 16 * 18


@pytest.mark.parametrize("lateness", [None, "1 day"])
def test_records_without_a_time_are_no_events(spark, tmp_path, lateness):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = StructType([StructField(f.name, f.dataType, True) for f in CHANGE_RECORD_SCHEMA])
    path = str(tmp_path / "in")
    for first in (0, 100):
        rows = [(first + n, None if n % 3 == 0 else start + datetime.timedelta(hours=3 * n + first), "C:", n % 2, 0x80000002, f"C:\\{n % 2}") for n in range(12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    clock = [(999, start + datetime.timedelta(days=9), "C:", 1, 0, "C:\\none")]
    for _ in range(2 if lateness else 0):
        spark.createDataFrame(clock, schema).coalesce(1).write.mode("append").parquet(path)
    source = stream_records(spark, path, max_files_per_trigger=1, schema=schema)
    query = write_events(watch(source, WINDOW, lateness=lateness), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(150)
    got = sorted((*key(r)[:4], r["renamed_from"] or "") for r in map(json.loads, lines(tmp_path / "out")))
    batch = replay(read_records(spark, path, schema), WINDOW).collect()
    assert len(got) == 16
    assert got == sorted((int(r.ts.timestamp()), r.volume, r.kind, r.path, r.renamed_from or "") for r in batch)


def test_stretches_of_time():
    part = pd.DataFrame({"at_us": [*range(5000, 0, -1), 1 << 50], "n": range(5001)})
    cut = [*stretches(part)]
    assert sorted(n for c in cut for n in c["n"]) == [*range(5001)]
    ends = [(c["at_us"].iloc[0], c["at_us"].iloc[-1]) for c in cut]
    assert all(high < low for (_, high), (low, _) in zip(ends, ends[1:]))
    assert 1 < len(cut) <= 18 and len([*stretches(part[:64])]) == 1 and not [*stretches(part[:0])]


def test_state_lifetime_text():
    assert ttl_millis("2 hours") == 7_200_000
    with pytest.raises(ValueError):
        ttl_millis("soon")
