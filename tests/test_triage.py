"""Triage: report order, files listed twice, hosts, and each name once over a watch that is killed and run again."""

import json

import pytest
from pyspark.sql import functions as F

from driftledger import WatchOptions, watch
from driftledger.operators import enrich, manifest
from driftledger.operators.diff import REPORT_COLUMNS
from driftledger.operators.events import enrich_events, event_digests
from driftledger.sources import filehash
from driftledger.sources.journal import stream_records
from driftledger.sources.triage import dump_changes
from driftledger.streaming import runner
from testbed import derive

TYPES = ", ".join(f"{c} {'long' if c.split('_')[-1] in ('frn', 'size', 'mtime') else 'string'}" for c in REPORT_COLUMNS)
SF = "/root/testdata/sf0.001"


def renamed(frn, before, after):
    return ("modified", "Renamed", "C:", frn, before, 1, 1, None, frn, after, 1, 1, None)


def test_sides_of_a_change_stay_together(spark, tmp_path):
    changes = spark.createDataFrame([renamed(2, "C:\\b.exe", "C:\\y.exe"), renamed(1, "C:\\z.exe", "C:\\a.exe")], TYPES)
    rows = manifest.in_report_order(manifest.manifest(changes)).collect()
    assert [(r.frn, r.side) for r in rows] == [(1, "before"), (1, "after"), (2, "before"), (2, "after")]
    dump_changes(changes, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out" / "manifest").glob("part*")) for x in f.read_text().splitlines()]
    assert [(r["frn"], r["side"]) for r in lines] == [(1, "before"), (1, "after"), (2, "before"), (2, "after")]
    assert set(lines[0]) == {"kind", "side", "original_path", "volume", "frn", "size", "mtime", "sha256_hex", "dumped_to"}


def test_a_file_listed_twice_counts_once(spark, tmp_path):
    content = spark.createDataFrame(
        [("C:", "C:\\a.exe", b"MZ1"), ("C:", "C:\\a.exe", b"MZ1"), ("C:", "C:\\m", b"MZ2"), ("C:", "C:\\m", b"MZ3")],
        "volume string, path string, content binary",
    )
    changes = spark.createDataFrame([renamed(1, "C:\\a.exe", "C:\\m")], TYPES)
    assert dump_changes(changes, str(tmp_path / "out"), content) == 2
    assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == 2
    files = spark.createDataFrame(
        [(1, "C:", 1, "C:\\a.exe", 5, False, None, None), (1, "C:", 2, "C:\\m", 5, False, None, None)],
        "snapshot_id long, volume string, frn long, path string, size long, is_dir boolean, sha256 string, digest2 string",
    )
    out = enrich.enrich_files(files, content).collect()
    assert len(out) == 2 and all(r.outcome == "hashed" for r in out)
    events = spark.createDataFrame([("C:", "C:\\a.exe", "Created")], "volume string, path string, kind string")
    assert enrich_events(events, event_digests(content)).count() == 1


def test_hosts_in_manifest_and_copies(spark):
    content = spark.createDataFrame(
        [("C:", "C:\\a.exe", "h1", b"one"), ("C:", "C:\\a.exe", "h2", b"two")], "volume string, path string, host string, content binary"
    )
    events = spark.createDataFrame(
        [("C:", "C:\\a.exe", "Created", h, None) for h in ("h1", "h2", "h3")], "volume string, path string, kind string, host string, renamed_from string"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows = manifest.event_manifest(enrich_events(events, event_digests(content)))
    assert sorted(r.host for r in rows.collect()) == ["h1", "h2"]
    kept = manifest.collect_content(rows.withColumnRenamed("dumped_to", "target_name"), content).collect()
    assert sorted(bytes(r.content) for r in kept) == [b"one", b"two"]


@pytest.mark.parametrize("fail_at", ["files", "manifest"])
def test_copied_once_over_a_watch_that_is_killed(spark, tmp_path, monkeypatch, fail_at):
    records = derive.records(spark, SF)
    for k in range(4):
        records.where(F.floor(F.col("usn") / 2600) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    content, asked = derive.event_content(spark, SF), []

    def read(files):
        asked.append(files)
        if fail_at == "files" and len(asked) == 6:  # the second reading of the third batch
            raise RuntimeError("killed")
        return content

    write, calls = runner._write_json, []

    def stopping(df, path):
        calls.append(path)
        write(df, path)
        if fail_at == "manifest" and len(calls) == 4:
            raise RuntimeError("killed")

    monkeypatch.setattr(runner, "_write_json", stopping)

    def run():
        stream = stream_records(spark, str(tmp_path / "in"), max_files_per_trigger=1)
        events = watch(stream, WatchOptions(window_ms=3_600_000))
        return runner.write_events_with_triage(events, read, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)

    with pytest.raises(RuntimeError, match="all watch sources failed"):
        runner.await_sources([run()])
    assert runner.await_sources([run()]) == []
    names = [r.target_name for r in spark.read.parquet(str(tmp_path / "out" / "files")).select("target_name").collect()]
    wanted = {json.loads(x)["dumped_to"] for f in (tmp_path / "out" / "manifest").rglob("*.json") for x in f.read_text().splitlines()}
    assert len(names) == len(set(names)) and set(names) == wanted


def test_files_are_copied_without_rows_of_bytes(spark, tmp_path):
    (tmp_path / "disk" / "d").mkdir(parents=True)
    (tmp_path / "disk" / "d" / "_a.exe").write_bytes(b"x" * 150_000)
    (tmp_path / "disk" / "b.exe").write_bytes(b"")
    rows = [("n1", "C:", "C:\\d\\_a.exe"), ("n1", "C:", "C:\\other.exe"), ("n2", "C:", "C:\\b.exe"), ("n3", "C:", "C:\\gone.exe")]
    picked = manifest.pick_sources(spark.createDataFrame(rows, "target_name string, volume string, path string"))

    def copy():
        done = filehash.copy_files(picked, {"C:": str(tmp_path / "disk")}, str(tmp_path / "out"))
        return {r.target_name: (r.result.split(":")[0], r.bytes) for r in done.collect()}

    assert copy() == {"n1": ("copied", 150_000), "n2": ("copied", 0), "n3": ("<error", 0)}
    assert copy() == {"n1": ("kept", 0), "n2": ("kept", 0), "n3": ("<error", 0)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["n1", "n2"]
