import random

import pytest
from pyspark.sql import functions as F

from driftledger.operators import manifest as m
from driftledger.operators.diff import REPORT_COLUMNS
from driftledger.operators.ranking import rank_in_groups
from driftledger.sources.triage import dump_changes

TYPES = ", ".join(
    f"{c} {'long' if c.split('_')[-1] in ('frn', 'size', 'mtime') else 'string'}" for c in REPORT_COLUMNS
)


def added(frn, path, sha=None, volume="C:"):
    return ("added", "Added", volume, None, None, None, None, None, frn, path, 1, 1, sha)


def removed(frn, path, sha=None, volume="C:"):
    return ("removed", "Removed", volume, frn, path, 1, 1, sha, None, None, None, None, None)


def modified(frn, path, b, a, volume="C:"):
    return ("modified", "Modified", volume, frn, path, 1, 1, b, frn, path, 2, 2, a)


def brute(rows):
    """The naming loop, in report order."""
    rank = {"added": 0, "removed": 1, "modified": 2}
    used, names = set(), {}
    for r in sorted(rows, key=lambda r: (rank[r[0]], r[2], r[3] if r[3] is not None else r[8])):
        for side, frn, path, sha in (("before", r[3], r[4], r[7]), ("after", r[8], r[9], r[12])):
            if frn is None:
                continue
            head, base = f"{sha[:16] if sha else 'nohash'}_{side}", path.rsplit("\\", 1)[-1]
            name, n = f"{head}_{base}", 1
            while name in used:
                name, n = f"{head}_{n}_{base}", n + 1
            used.add(name)
            names[r[0], r[2], frn, side] = name
    return names


def named(spark, rows):
    got = m.manifest(spark.createDataFrame(rows, TYPES)).collect()
    cats = ("added", "removed", "modified", "replaced")
    return {(cats[r.category_rank], r.volume, r.frn, r.side): r.target_name for r in got}


def test_numbered_file_names_do_not_collide(spark):
    rows = [added(n, f"C:\\{n}\\f.dll") for n in (1, 2, 4)] + [added(3, "C:\\x\\1_f.dll"), added(5, "C:\\y\\1_f.dll")]
    got = named(spark, rows)
    assert got == brute(rows)
    assert got["added", "C:", 3, "after"] == "nohash_after_1_1_f.dll" and len(set(got.values())) == 5


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    pool = ["f.dll", "1_f.dll", "2_f.dll", "1_1_f.dll", "01_f.dll", "3_f.dll", "12_f.dll", "2_1_f.dll", "g.exe",
            "99999999999999999999_f.dll"]
    shas = [None, None, "a" * 64, "b" * 64]
    rows = []
    for n in range(400):
        name = "f.dll" if rng.random() < 0.4 else rng.choice(pool)
        path, vol = f"C:\\d{n}\\{name}", rng.choice(["C:", "D:"])
        kind = rng.random()
        if kind < 0.4:
            rows.append(added(n, path, rng.choice(shas), vol))
        elif kind < 0.7:
            rows.append(removed(n, path, rng.choice(shas), vol))
        else:
            rows.append(modified(n, path, rng.choice(shas), rng.choice(shas), vol))
    got = named(spark, rows)
    assert got == brute(rows)
    assert len(set(got.values())) == len(got)


def test_rank_of_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.xxhash64("id").alias("o"),
    )
    got = rank_in_groups(df, ["g"], ["o"], "n").toPandas()
    want = got.sort_values(["g", "o"]).groupby("g").cumcount() + 1
    assert (got["n"] == want.reindex(got.index)).all()


def test_dump_writes_manifest_and_bytes_once(spark, tmp_path):
    rows = [added(1, "C:\\a.dll", "c" * 64), added(2, "C:\\n.txt"), added(3, "C:\\m.txt"), removed(4, "C:\\gone.sys", "d" * 64)]
    content = spark.createDataFrame(
        [("C:", "C:\\a.dll", b"A"), ("C:", "C:\\n.txt", b"no"), ("C:", "C:\\m.txt", b"MZ!")],
        "volume string, path string, content binary")
    changes = spark.createDataFrame(rows, TYPES)
    assert dump_changes(changes, str(tmp_path / "out"), content) == 3
    lines = spark.read.json(str(tmp_path / "out" / "manifest")).collect()
    assert {r.original_path: r.dumped_to for r in lines} == {
        "C:\\a.dll": "cccccccccccccccc_after_a.dll", "C:\\m.txt": "nohash_after_m.txt", "C:\\gone.sys": "<error: no content>"}
    files = spark.read.parquet(str(tmp_path / "out" / "files")).collect()
    assert {r.target_name: bytes(r.content) for r in files} == {
        "cccccccccccccccc_after_a.dll": b"A", "nohash_after_m.txt": b"MZ!"}
