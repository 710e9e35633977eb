"""Real files: nothing left out of a tree, candidates alone are opened, large files in bounded memory."""

import hashlib
import os
import resource

from driftledger.sources import filehash

FILES = "snapshot_id long, volume string, frn long, path string, size long, is_dir boolean, sha256 string, digest2 string, note string"


def test_outcomes_and_bytes_read(spark, tmp_path):
    def put(name, body):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
        return len(body)

    given = {
        "a/x.exe": b"plain", "a/_y.DLL": b"z" * 200_001, "a/.z.log": b"MZ" + b"q" * 70_000, "a/doc.txt": b"hello",
        "a/one": b"M", "a/none.exe": b"", "b.c/sys": b"MZ",
    }
    rows = [(1, "D:", i, "D:\\" + n.replace("/", "\\"), put(n, b), False, None, None, "n") for i, (n, b) in enumerate(given.items())]
    rows += [(1, "D:", 20, "D:\\a", 5, True, None, None, "n"), (1, "D:", 21, "D:\\gone.exe", 5, False, "old", None, "n"),
             (1, "E:", 22, "E:\\a\\x.exe", 5, False, None, None, "n"), (1, "D:", 23, "D:\\..\\a\\x.exe", 5, False, None, None, "n"),
             (1, "D:", 24, "D:\\a\\x.exe", 209_715_201, False, "kept", None, "n")]
    out = {r.frn: r for r in filehash.hash_files(spark.createDataFrame(rows, FILES), {"D:": str(tmp_path)}, "xxhash64").collect()}
    bodies = list(given.values())
    assert [out[i].outcome for i in range(7)] == ["hashed", "hashed", "hashed", "skipped", "skipped", None, "hashed"]
    assert [out[i].bytes_read for i in range(7)] == [5, 200_001, 70_002, 2, 1, 0, 2]
    assert all(out[i].sha256 == hashlib.sha256(bodies[i]).hexdigest() for i in (0, 1, 2, 6))
    # the same digest as the column expression gives
    want = spark.sql("select lower(lpad(hex(xxhash64(cast('plain' as binary))), 16, '0'))").first()[0]
    assert out[0].digest2 == want and out[3].sha256 is None and out[0].note == "n"
    assert [out[i].outcome for i in (20, 21, 22, 23, 24)] == [None, "failed", "failed", "failed", None]
    assert out[21].sha256 == "old" and out[24].sha256 == "kept" and out[24].bytes_read == 0


def test_a_file_is_never_held(tmp_path):
    target = tmp_path / "large.exe"
    with open(target, "wb") as f:
        f.truncate(600 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    outcome, sha, _, read = filehash.digest_file(str(target), True, None)
    assert (outcome, read) == ("hashed", 600 << 20) and len(sha) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50 << 10


def test_tree_leaves_nothing_out(spark, tmp_path):
    for name in ("top.txt", "_u", ".hidden", "d/e/f/deep.bin", "d/.git/x", "d/empty", "w/_w"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name.endswith("empty") else b"abc")
    (tmp_path / "void").mkdir()
    got = sorted((r.path, r.size, r.is_dir) for r in filehash.read_tree(spark, str(tmp_path), "C:", 3).collect())
    want = []
    for base, folders, files in os.walk(tmp_path):
        for n in (*folders, *files):
            full = os.path.join(base, n)
            is_dir = os.path.isdir(full)
            want.append(("C:\\" + os.path.relpath(full, tmp_path).replace("/", "\\"), 0 if is_dir else os.path.getsize(full), is_dir))
    assert got == sorted(want)
    hashed = filehash.hash_files(
        filehash.read_tree(spark, str(tmp_path), "C:").selectExpr("*", "cast(null as string) as sha256", "cast(null as string) as digest2"),
        {"C:": "file://" + str(tmp_path)},
    )
    assert hashed.where("outcome = 'skipped'").count() == 6
