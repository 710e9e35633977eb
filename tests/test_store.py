import pytest
from pyspark.sql import functions as F

from driftledger import DiffOptions, Rule, ScanOptions, SnapshotStore, diff_snapshots, ingest_snapshot
from driftledger.model import SCAN_RECORD_SCHEMA
from driftledger.operators import rules
from driftledger.operators.selection import scan_stats
from driftledger.plans.scan import hash_snapshot
from driftledger.sources.rulefile import read_rules, rules_document, write_rules
from driftledger.sources.store import SnapshotExists, SnapshotNotFound


def record(frn, path, seq, size=5, volume="C:", is_dir=False):
    return (volume, frn, 0, path, path.rsplit("\\", 1)[-1], size, 10, 10, is_dir, seq)


def records(spark, rows):
    return spark.createDataFrame(rows, SCAN_RECORD_SCHEMA)


ROWS = [
    record(1, "C:\\a.dll", 1), record(1, "C:\\b.dll", 9, size=7), record(1, "C:\\c.dll", 3),
    record(2, "", 4), record(3, "C:\\Noise\\x", 5), record(4, "C:\\d", 6, is_dir=True),
    record(1, "D:\\a.exe", 7, volume="D:"),
]


@pytest.mark.parametrize("buckets", [0, 3])
def test_scan_store_diff_delete(spark, buckets):
    store = SnapshotStore(spark, prefix=f"t{buckets}_", buckets=buckets).create().create()
    content = spark.createDataFrame(
        [("C:", "C:\\b.dll", 7, b"MZ1")], "volume string, path string, length long, content binary"
    )
    options = ScanOptions(rules=(Rule("prefix", "c:/noise"),))
    got = ingest_snapshot(store, records(spark, ROWS), "one", options, content, taken_at=100, host="H")
    assert (got.total, got.sent, got.skipped, got.written) == (7, 5, 2, 3)
    assert (got.considered, got.hashed, got.failed) == (2, 1, 1)
    kept = {(r.volume, r.frn): r for r in store.files("one").collect()}
    assert set(kept) == {("C:", 1), ("C:", 4), ("D:", 1)}
    assert kept["C:", 1].path == "C:\\b.dll" and kept["C:", 1].size == 7  # last record wins
    assert len(kept["C:", 1].sha256) == 64 and kept["D:", 1].sha256 is None

    with pytest.raises(SnapshotExists):
        ingest_snapshot(store, records(spark, ROWS), "one")
    # a failed run leaves no name behind
    with pytest.raises(LookupError, match="no matching volumes"):
        ingest_snapshot(store, records(spark, ROWS), "two", ScanOptions(volumes=("Q",)))
    assert store.find("two") is None
    later = [record(1, "C:\\b.dll", 1, size=8), record(9, "C:\\new", 2)]
    second = ingest_snapshot(store, records(spark, later), "two", ScanOptions(hash_content=False), taken_at=200)
    assert [r.name for r in store.list().collect()] == ["two", "one"]
    changes = diff_snapshots(store, "one", "two", DiffOptions())
    assert sorted(r.kind for r in changes.collect()) == ["Added", "Modified", "Removed"]
    with pytest.raises(SnapshotNotFound, match="no snapshot is called 'zzz'"):
        diff_snapshots(store, "one", "zzz")

    # the hash pass rewrites one partition and leaves the other alone
    assert hash_snapshot(store, "two", content, "sha512") == {"considered": 2, "hashed": 1, "failed": 1}
    assert len(store.files("two").filter("frn = 1").head().digest2) == 128
    assert store.files("one").count() == 3

    # rows of a run that never took its name are in no snapshot
    unnamed = spark.createDataFrame(store.files("one").collect(), store.files().schema)
    with pytest.raises(Exception, match="row of another snapshot"):
        store.write_files(unnamed, 99)
    store.write_files(unnamed.withColumn("snapshot_id", unnamed.frn * 0 + 99), 99)
    assert store.files().filter("snapshot_id = 99").isEmpty() and store.files().count() == 5

    assert store.delete("two") == 2
    assert store.files().count() == 3 and store.find("two") is None
    assert store.reserve_id() > second.snapshot_id  # ids are not reused
    store.analyze()


def test_writes_need_no_session_setting(spark):
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        store = SnapshotStore(spark, prefix="plain_").create()
        row = spark.createDataFrame([(None,) * len(store.files().columns)], store.files().schema)
        for n in (1, 2, 1):
            store.write_files(row.withColumn("snapshot_id", F.lit(n).cast("long")), n)
        ids = spark.table(store.files_table).select("snapshot_id").collect()
        assert sorted(r.snapshot_id for r in ids) == [1, 2]
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def test_bucketed_snapshots_join_without_shuffle(spark):
    store = SnapshotStore(spark, prefix="bk_", buckets=4).create()
    for name in ("x", "y"):
        ingest_snapshot(store, records(spark, ROWS), name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from driftledger.operators.diff import frn_changes

        changes = frn_changes(store.files("x"), store.files("y"), DiffOptions())
        plan = changes._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" in plan and "Exchange" not in plan
        assert changes.count() == 0
        assert "PartitionFilters: [isnotnull(snapshot_id" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_limits_groups_before_the_shuffle(spark):
    from driftledger.operators.ingest import latest_records

    plan = latest_records(records(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    limit, exchange = plan.rindex("WindowGroupLimit"), plan.index("Exchange hashpartitioning")
    assert limit > exchange  # below the exchange in the tree


def test_scan_stats_per_volume(spark):
    got = scan_stats(records(spark, ROWS), rules.compile_rules([Rule("prefix", "c:/noise")]))
    assert {r.volume: (r.total, r.sent, r.skipped) for r in got.collect()} == {"C:": (6, 4, 2), "D:": (1, 1, 0)}


def test_rule_file_and_maintenance(spark, tmp_path):
    path = str(tmp_path / "config.json")
    shipped = read_rules(spark, path)
    assert rules.rules_from(shipped) == rules.DEFAULT_RULES
    (tmp_path / "config.json").write_text(rules_document(rules.DEFAULT_RULES[:2]))
    frame = read_rules(spark, path)
    assert [r.pos for r in frame.collect()] == [1, 2]
    frame = rules.add_rule(frame, "RE", ".*\\\\Noise\\\\.*")
    frame = rules.add_rule(frame, "regex", ".*\\\\Noise\\\\.*")
    frame = rules.add_rule(frame, "prefix", "7")
    assert [(r.pos, r.kind) for r in frame.orderBy("pos").collect()] == [
        (1, "prefix"), (2, "prefix"), (3, "regex"), (4, "prefix")]
    with pytest.raises(ValueError):
        rules.add_rule(frame, "regex", "(")
    with pytest.raises(IndexError, match="no rule number 7; there are 4"):
        rules.remove_rule(frame, "7")  # a number is a position, never a pattern
    with pytest.raises(LookupError):
        rules.remove_rule(frame, "no such pattern")
    fewer = rules.remove_rule(rules.remove_rule(frame, "1"), ".*\\\\Noise\\\\.*")
    listed = rules.list_rules(fewer, {"LOCALAPPDATA": "L"}).collect()
    assert [(r.pos, r.expanded) for r in listed] == [(1, "L\\Microsoft\\Windows"), (2, "7")]
    write_rules(spark, rules.rules_from(fewer), str(tmp_path / "out"))
    assert rules.rules_from(read_rules(spark, str(tmp_path / "out"))) == rules.rules_from(fewer)
    empty = spark.createDataFrame([], fewer.schema)
    assert rules.add_rule(empty, "glob", "*").collect()[0].pos == 1


def test_candidates_and_outcomes(spark):
    from driftledger.operators import enrich

    sizes = [0, 1, 209715200, 209715201]
    files = spark.createDataFrame([("C:", n, f"C:\\{n}.exe", s, False, None, None) for n, s in enumerate(sizes)],
                                  "volume string, frn long, path string, size long, is_dir boolean, sha256 string, digest2 string")
    assert [r.frn for r in files.filter(enrich.hash_candidate()).orderBy("frn").collect()] == [1, 2]
    more = spark.createDataFrame(
        [("C:", 1, "C:\\.exe", 5, False, "old", "o2"), ("C:", 2, "C:\\t.txt", 5, False, "old", None),
         ("C:", 3, "C:\\m.txt", 5, False, None, None), ("C:", 4, "C:\\gone.dll", 5, False, "old", None),
         ("C:", 5, "C:\\d", 5, True, None, None), ("C:", 6, "C:\\m.txt", 5, False, None, None)], files.schema)
    content = spark.createDataFrame(
        [("C:", "C:\\.exe", 3, b"abc"), ("C:", "C:\\t.txt", 3, b"abc"), ("C:", "C:\\m.txt", 3, b"MZ."), ("C:", "C:\\gone.dll", 0, None)],
        "volume string, path string, length long, content binary")
    out = enrich.enrich_files(more, content)
    got = {r.frn: (r.outcome, r.sha256 and r.sha256[:4], r.digest2) for r in out.collect()}
    assert got == {1: ("hashed", "ba78", None), 2: ("skipped", "old", None), 3: got[3],
                   4: ("failed", "old", None), 5: (None, None, None), 6: got[3]}
    assert got[3][0] == "hashed" and len(got[3][1]) == 4
    assert enrich.hash_stats(out).head().asDict() == {"considered": 5, "hashed": 3, "failed": 1}


def test_content_from_files(spark, tmp_path):
    from driftledger.sources.content import read_content

    (tmp_path / "dir a").mkdir()
    (tmp_path / "dir a" / "x.dll").write_bytes(b"MZ1")
    (tmp_path / "y.bin").write_bytes(b"12345")
    (tmp_path / "empty.exe").write_bytes(b"")
    got = read_content(spark, str(tmp_path), "C:", max_length=4)
    assert [(r.volume, r.path, r.length, bytes(r.content)) for r in got.collect()] == [("C:", "C:\\dir a\\x.dll", 3, b"MZ1")]
