import pytest
from pyspark.sql import functions as F

from driftledger.functions import paths, values
from driftledger.operators.rules import normalize_extensions
from driftledger.operators.selection import volume_selected


def test_extensions(rows):
    cases = {
        r"C:\.exe": ("", "exe"), r"a.dll\x": ("", "dll\\x"), "a.": ("", ""), r"C:\d.d\A.ExE": ("exe", "exe"),
        "noext": ("", ""), r"x/y.TAR.Gz": ("gz", "gz"), r"C:\a..b": ("b", "b"), "": ("", ""), "a/.b.c": ("c", "c"),
    }
    assert rows(list(cases), paths.name_extension) == [v[0] for v in cases.values()]
    assert rows(list(cases), paths.path_extension) == [v[1] for v in cases.values()]
    assert rows([r"C:\.exe", r"a.dll\x", "a."], paths.has_pe_path_extension) == [True, False, False]


def test_basename(rows):
    got = rows(["C:\\a\\b.dll", "C:/a/b", "C:\\a\\", "C:", "C:\\", "..", "x", ""], paths.basename)
    assert got == ["b.dll", "b", "a", "unnamed.bin", "unnamed.bin", "unnamed.bin", "x", "unnamed.bin"]


@pytest.mark.parametrize(
    "path, mount, want",
    [
        (r"\\?\E:\logs\day.csv", "E:\\", r"E:\logs\day.csv"),
        (r"\\?\e:\logs\day.csv", "E:\\", r"E:\logs\day.csv"),
        (r"\\.\E:\logs\day.csv", "E:\\", r"E:\logs\day.csv"),
        (r"\logs\day.csv", "E:\\", r"E:\logs\day.csv"),
        (r"/logs/day.csv", "E:\\", r"E:/logs/day.csv"),
        (r"logs\day.csv", "E:\\", r"E:\logs\day.csv"),
        (r"Q:\logs", "E:\\", r"Q:\logs"),
        (r"\\?\Q:\logs", "E:\\", r"Q:\logs"),
        (r"\\server\share", "E:\\", r"\\server\share"),
        (r"\\?\Volume{9}\logs\day.csv", None, r"\\?\Volume{9}\logs\day.csv"),
        (r"\\?\Volume{9}\logs", "K:\\at\\", r"\\?\Volume{9}\logs"),
        (r"\logs", None, r"\logs"),
    ],
)
def test_record_path(spark, path, mount, want):
    df = spark.createDataFrame([(path, mount)], "p string, m string")
    assert df.select(paths.record_path(F.col("p"), F.col("m"))).head()[0] == want


def test_numbers_and_times(rows):
    assert [str(v) for v in rows([-1, 5, -(2**63)], values.unsigned_id, "long")] == [
        "18446744073709551615", "5", "9223372036854775808"]
    assert rows([-1, 5, -(2**63)], lambda c: values.signed_id(values.unsigned_id(c)), "long") == [-1, 5, -(2**63)]
    assert rows([0, 1700000000, 2**62], values.clock_text, "long") == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", "?"]
    assert rows([None], values.unix_or_zero, "timestamp") == [0]
    assert rows([b"MZx", b"M", b"", None], values.starts_with_mz, "binary") == [True, False, False, False]
    assert rows([b"MZ"], values.hex_lower, "binary") == ["4d5a"]
    assert rows(["0123456789abcdef99", None], values.short_hash) == ["0123456789abcdef", "nohash"]


def test_volume_selectors(rows):
    guid = "\\\\?\\Volume{a}\\"
    for selector in ("c", "C:", " c:\\ "):
        assert rows(["C:", "D:", guid], lambda c, s=selector: volume_selected(c, [s])) == [True, False, False]
    assert rows([guid], lambda c: volume_selected(c, [guid])) == [False]


def test_extension_list():
    assert normalize_extensions([" .Exe ", "..dll", "", "."]) == ("dll", "exe")
    assert len(normalize_extensions(["pe", "exe"])) == 10
