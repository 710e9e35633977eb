import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftledger import DiffOptions, Rule, diff
from driftledger.operators import diff as ops
from driftledger.operators import sift
from driftledger.plans.compare import diff_summary
from driftledger.operators.report import report_json
from driftledger.sources.workdir import stored
from testbed import derive
from testbed.catalog import QUERIES

COLS = "volume string, frn long, path string, size long, mtime long, is_dir boolean, sha256 string"


def file(frn, path, size=1, mtime=1, is_dir=False, sha=None, volume="C:"):
    return (volume, frn, path, size, mtime, is_dir, sha)


@pytest.fixture
def run(spark):
    def go(before, after, **options):
        b, a = spark.createDataFrame(before, COLS), spark.createDataFrame(after, COLS)
        full = sorted(map(tuple, diff(b, a, DiffOptions(**options)).collect()), key=repr)
        parts = diff(b, a, DiffOptions(limit=10_000, **options)).collect()
        assert full == sorted(map(tuple, parts), key=repr)  # full outer form = four queries
        ids = [(r[1], r[3], r[8]) for r in full]
        return sorted((k, -1 if b is None else b, -1 if a is None else a) for k, b, a in ids)

    return go


def test_content_rule(run):
    before = [file(1, "a", 1, 1, sha="x"), file(2, "b", 1, 1, sha="x"), file(3, "c", 1, 1, sha="x"), file(4, "d", 1, 1)]
    after = [file(1, "a", 9, 9, sha="x"), file(2, "b", 1, 1, sha="y"), file(3, "c", 1, 1), file(4, "d", 1, 2)]
    assert run(before, after) == [("Modified", 2, 2), ("Modified", 4, 4)]


def test_kinds_and_case(run):
    before = [file(1, "A"), file(2, "b"), file(3, "c")]
    after = [file(1, "a"), file(2, "b2", 5), file(3, "c")]
    assert run(before, after) == [("Renamed", 1, 1), ("RenamedModified", 2, 2)]


def test_directory_that_becomes_a_file_is_reported_nowhere(run):
    before = [file(1, "a", is_dir=True), file(2, "b"), file(3, "c", is_dir=True)]
    after = [file(1, "a"), file(2, "b", is_dir=True), file(4, "d", is_dir=True)]
    assert run(before, after) == []
    # with directories, only the unknown ids show: type is not compared
    assert run(before, after, include_dirs=True) == [("Added", -1, 4), ("Removed", 3, -1)]


def test_categories_overlap(run):
    assert run([file(1, "a")], [file(2, "a")]) == [("Added", -1, 2), ("Removed", 1, -1), ("Replaced", 1, 2)]
    assert run([file(1, "a"), file(2, "b")], [file(1, "b"), file(2, "a")]) == [
        ("Renamed", 1, 1), ("Renamed", 2, 2), ("Replaced", 1, 2), ("Replaced", 2, 1)]


def test_replaced_keeps_multiplicity(run):
    same = [file(1, "p"), file(2, "p")]
    assert run(same, same) == [("Replaced", 1, 2), ("Replaced", 2, 1)]


def test_counts_without_pairs(spark):
    """One path holds most files on both sides; the counts match the report."""
    before = spark.createDataFrame([file(n, "hot" if n % 3 else f"p{n}") for n in range(60)], COLS)
    after = spark.createDataFrame(
        [file(n + 20, "hot" if n % 4 else f"p{n}", is_dir=n % 9 == 0) for n in range(60)], COLS)
    for options in (DiffOptions(), DiffOptions(limit=7), DiffOptions(rules=(Rule("prefix", "hot"),)),
                    DiffOptions(include_dirs=True, rules=(Rule("regex", "p1"),))):
        want = {r.category: r.n for r in ops.summary(diff(before, after, options)).collect()}
        assert {r.category: r.n for r in diff_summary(before, after, options).collect()} == want


def test_same_id_on_another_volume_is_another_file(run):
    assert run([file(1, "a")], [file(1, "a", volume="D:")]) == [("Added", -1, 1), ("Removed", 1, -1)]


def test_either_side_keeps_an_id_match_only(run):
    before = [file(1, r"C:\Noise\a"), file(2, r"C:\Noise\b"), file(3, r"C:\Noise\c")]
    after = [file(1, r"C:\Work\a"), file(2, r"C:\Noise\b", 2), file(4, r"C:\Noise\c")]
    rule = (Rule("prefix", "c:/noise"),)
    assert run(before, after, rules=rule) == [("Renamed", 1, 1)]
    assert run(before, after, hidden_paths=("C:\\Noise",)) == [("Renamed", 1, 1)]
    assert len(run(before, after, hidden_paths=("C:\\Noise",), include_self=True)) == 5
    assert run([file(1, "a.dll")], [file(1, "a.tmp")], extensions=(".DLL",)) == [("Renamed", 1, 1)]


def test_limit_is_per_category_after_filtering(spark):
    before = spark.createDataFrame([file(n, rf"C:\{'Noise' if n < 5 else 'x'}\{n}") for n in range(20)], COLS)
    after = spark.createDataFrame([file(n + 100, rf"C:\y\{n}") for n in range(20)], COLS)
    got = diff(before, after, DiffOptions(limit=3, rules=(Rule("prefix", "C:\\noise"),))).collect()
    assert sorted((r.category, r.before_frn or r.after_frn) for r in got) == [
        ("added", 100), ("added", 101), ("added", 102), ("removed", 5), ("removed", 6), ("removed", 7)]


COUNTS = {
    "sf0.001": {"Added": 19, "Removed": 18, "Modified": 32, "Renamed": 46, "RenamedModified": 9, "Replaced": 27},
    "sf0.01": {"Added": 96, "Removed": 91, "Modified": 160, "Renamed": 227, "RenamedModified": 45, "Replaced": 128},
}


@pytest.mark.parametrize("sf", COUNTS)
def test_fixture_counts(spark, sf):
    pair = derive.documents_pair(spark, f"/root/testdata/{sf}")
    got = {r.kind: r["count"] for r in diff(*pair).groupBy("kind").count().collect()}
    assert got == COUNTS[sf]


def test_identity_and_symmetry(spark):
    before, after = derive.documents_pair(spark, "/root/testdata/sf0.001")
    assert ops.frn_changes(before, before, DiffOptions()).isEmpty()
    there = {r.category: r.n for r in ops.summary(diff(before, after)).collect()}
    back = {r.category: r.n for r in ops.summary(diff(after, before)).collect()}
    assert back == {**there, "added": there["removed"], "removed": there["added"]}
    none = {r.category: r.n for r in ops.summary(diff(before, before).limit(0)).collect()}
    assert none == dict.fromkeys(there, 0)


def test_bad_pattern_fails_before_any_task(spark):
    one = spark.createDataFrame([file(1, "a")], COLS)
    with pytest.raises(ValueError, match="bad pattern in rules"):
        diff(one, one, DiffOptions(rules=(Rule("regex", r"\p{NoSuchScript}"),)))


def test_json_entry(spark):
    b = spark.createDataFrame([file(-1, "C:\\é\"x", sha="ab")], COLS)
    got = report_json(diff(b, b.limit(0))).head()
    assert got.entry_json == (
        '{"kind":"Removed","before":{"volume":"C:","frn":18446744073709551615,"path":"C:\\\\é\\"x",'
        '"size":1,"mtime":1,"sha256_hex":"ab"},"after":null}'
    )


def test_plan_shape(spark, tmp_path):
    """Both sides scanned with the needed columns only, directories and nothing else cut early."""
    before, after = derive.documents_pair(spark, "/root/testdata/sf0.001")
    before.withColumns({c: before.size for c in ("parent_frn", "ctime")}).write.parquet(str(tmp_path / "b"))
    after.write.parquet(str(tmp_path / "a"))
    b, a = spark.read.parquet(str(tmp_path / "b")), spark.read.parquet(str(tmp_path / "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = diff(b, a)._jdf.queryExecution().executedPlan().toString()
        capped = diff(b, a, DiffOptions(limit=5))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FullOuter") == 1 and plan.count("Exchange hashpartitioning") == 4
    assert capped.count("TakeOrderedAndProject") == 4 and capped.count("LeftAnti") == 2
    assert "ctime" not in plan and "parent_frn" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def odd_files(seed, rows=400):
    """Ids and paths that repeat, on both sides and on one, and columns of which any may be missing."""
    pick = random.Random(seed)

    def some(values, none=0.05):
        return None if pick.random() < none else pick.choice(values)

    def one():
        n = pick.randrange(150)
        path = "hot" if n % 10 == 0 else f"C:\\{'Noise' if n % 3 else 'x'}\\{n}"
        return (some(["C:", "D:"], 0.02), some([n, n, n, n + 1]), some([path] * 3 + ["p"]), some([1, 1, 2]), some([1, 1, 2]),
                some([False] * 5 + [True]), some([None, "x", "y~"]))

    before = [one() for _ in range(rows)]
    return before, [one() if pick.random() < 0.1 else r for r in before if pick.random() < 0.95]


@pytest.mark.parametrize(("cells", "per_hash"), [(sift.CELLS, 1000), (64, 16)])
def test_sifted_report_is_the_same(spark, monkeypatch, cells, per_hash):
    """Repeated and missing keys and values, directories, rules and limits: row for row what all rows give."""
    monkeypatch.setattr(sift, "CELLS", cells)
    monkeypatch.setattr(sift, "CELLS_PER_HASH", per_hash)
    before, after = (spark.createDataFrame(x, COLS).coalesce(2).cache() for x in odd_files(cells))
    plain, others = DiffOptions(), DiffOptions(include_dirs=True, rules=(Rule("prefix", "c:/noise"),))
    for b, a, options in (
        (before, after, plain), (before, after, others), (before, before, plain), (after, before.limit(0), plain),
        (before, after, DiffOptions(limit=7)),
    ):
        want = sorted(map(tuple, diff(b, a, options).collect()), key=repr)
        got = sorted(map(tuple, diff(b, a, options, sift=True).collect()), key=repr)
        assert len(got) == len(want)
        if not options.limit:  # with missing keys the first rows are not determined
            assert got == want
    assert {r[0] for r in diff(before, after, sift=True).collect()} == {"added", "removed", "modified", "replaced"}


def test_settled_rows_stay_where_they_are(spark):
    """Ten thousand files with a few changes: the joins get those, not all rows."""
    n = F.col("id")
    before = spark.range(10_000).select(
        F.lit("C:").alias("volume"), n.alias("frn"), F.concat(F.lit("C:\\f"), n).alias("path"), n.alias("size"),
        n.alias("mtime"), F.lit(False).alias("is_dir"), F.sha2(n.cast("string"), 256).alias("sha256"),
    )
    moved = F.when(n == 3, 20_000 + n).otherwise(n)
    after = before.withColumn("id", F.col("frn")).filter(n != 1).withColumns(
        {"frn": moved, "sha256": F.when(n == 2, "changed").otherwise(F.col("sha256"))}).drop("id")
    by_id, by_path = ops.sifted(before, after, DiffOptions())
    kept = [{r.frn for r in df.select("frn").collect()} for df in (*by_id, *by_path)]
    for found, must in zip(kept, ({1, 2, 3}, {2, 20_003}, {3}, {20_003})):
        assert must <= found and len(found) < 100
    got = {(r.category, r.before_frn, r.after_frn) for r in diff(before, after, sift=True).collect()}
    assert got == {("removed", 1, None), ("removed", 3, None), ("added", None, 20_003), ("modified", 2, 2), ("replaced", 3, 20_003)}


def test_stored_rows_leave_no_shuffle_files(spark):
    def shuffles():
        root = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
        return {p.name for p in root.rglob("shuffle_*")}

    there = shuffles()
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    until = time.time() + 20
    while shuffles() - there and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffles() - there and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_large_pair_is_sifted(spark):
    report = QUERIES["diff_inventory"](spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/marks-") >= 2 and plan.count("FullOuter") == 1
    pair = derive.lineitem_pair(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, report.collect()), key=repr) == sorted(map(tuple, diff(*pair).collect()), key=repr)
