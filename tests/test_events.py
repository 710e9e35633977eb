import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftledger import Rule, WatchOptions, replay
from driftledger.model import CHANGE_RECORD_SCHEMA
from driftledger.operators import events as ops
from driftledger.operators.throttle import NEVER, composed, throttle

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
CLOSE, CREATE, DELETE, OLD, NEW, EXTEND, BASIC = 0x80000000, 0x100, 0x200, 0x1000, 0x2000, 0x2, 0x8000


def at(ms):
    return T0 + datetime.timedelta(milliseconds=ms)


def rec(usn, reason, path="C:\\a", frn=1, ms=None, volume="C:"):
    return (usn, at(usn * 10_000 if ms is None else ms), volume, frn, reason, path)


@pytest.fixture
def records(spark):
    return lambda rows: spark.createDataFrame(rows, CHANGE_RECORD_SCHEMA)


def test_kinds_and_old_half(records):
    reasons = [0x200, 0x80000300, 0x80002102, 0x80001200, CLOSE | BASIC, CLOSE | 4, CLOSE | NEW | EXTEND, CLOSE | OLD | NEW]
    df = records([rec(n, r, frn=n) for n, r in enumerate(reasons)])
    got = ops.classify_events(ops.prepare_records(df, WatchOptions()))
    assert {r.usn: r.kind for r in got.collect()} == {1: "Deleted", 2: "Created", 5: "Modified", 6: "Renamed", 7: "Renamed"}


def brute_pairs(rows):
    last, found = {}, {}
    for usn, _, volume, frn, reason, path in sorted(rows, key=lambda r: (r[2], r[0])):
        if reason & CLOSE and reason & NEW and not reason & (DELETE | CREATE):
            found[volume, usn] = last.get((volume, frn))
        if reason & OLD:
            last[volume, frn] = path
    return found


@pytest.mark.parametrize("piece", [1, 7, 1 << 22])
def test_rename_pairing(records, piece):
    rng = random.Random(5)
    rows = [
        rec(usn, rng.choice([OLD, CLOSE | NEW, CLOSE | OLD | NEW, CLOSE | CREATE | OLD, CLOSE | EXTEND]),
            f"C:\\p{usn}", frn=1 if rng.random() < 0.7 else rng.randrange(5), volume=rng.choice(["C:", "D:"]))
        for usn in range(1, 300)
    ]
    got = ops.pair_renames(ops.prepare_records(records(rows), WatchOptions()), piece).collect()
    assert {(r.volume, r.usn): r.renamed_from for r in got if r.kind == "Renamed"} == brute_pairs(rows)
    assert any(v is None for v in brute_pairs(rows).values())
    assert all(r.renamed_from is None for r in got if r.kind != "Renamed")


def brute_throttle(rows, window_us):
    last, out = {}, set()
    for us, volume, usn, path, kind in sorted(rows):
        prev = last.get((path, kind))
        if prev is None or us - prev >= window_us:
            last[path, kind] = us
            out.add((volume, usn))
    return out


def run_throttle(spark, rows, window_ms, spans):
    df = spark.createDataFrame(rows, "us long, volume string, usn long, path string, kind string")
    df = df.select(F.timestamp_micros("us").alias("ts"), "volume", "usn", "path", "kind")
    got = [(r.volume, r.usn) for r in throttle(df, window_ms, windows_per_span=spans).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_window_edges(spark):
    base = 1_700_000_000_000_000
    rows = [(base + ms * 1000, "C:", ms, "p", "Modified") for ms in (0, 500, 799, 800, 1500, 1600)]
    assert run_throttle(spark, rows, 800, 64) == {("C:", 0), ("C:", 800), ("C:", 1600)}


@pytest.mark.parametrize("spans", [1, 2, 5, 64])
def test_throttle_equals_sequential_rule(spark, spans):
    """Random, periodic (orbits never merge), duplicated and bursty keys; one key is hot."""
    rng = random.Random(spans)
    base = 1_700_000_000_000_000
    rows, usn = [], 0
    for key, step in (("steady", 500_000), ("third", 333_333), ("half", 400_000)):
        for n in range(900):
            usn += 1
            rows.append((base + n * step, "C:", usn, key, "Modified"))
    for _ in range(3000):
        usn += 1
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        us = base + rng.randrange(400) * 250_000 + (rng.randrange(1000) if rng.random() < 0.5 else 0)
        rows.append((us, rng.choice(["C:", "D:"]), usn, key, rng.choice(["Modified", "Created"])))
    assert run_throttle(spark, rows, 800, spans) == brute_throttle(rows, 800_000)


def test_replay_filters_before_throttle_and_sees_the_new_path_only(records):
    rows = [
        rec(1, CLOSE | EXTEND, "\\\\?\\C:\\Noise\\a.exe", ms=0), rec(2, CLOSE | EXTEND, "\\w\\a.exe", ms=10),
        rec(3, CLOSE | EXTEND, "c:\\w\\a.exe", ms=20), rec(4, OLD, "C:\\Noise\\b.exe", frn=2, ms=30),
        rec(5, CLOSE | NEW, "C:\\w\\b.exe", frn=2, ms=40), rec(6, CLOSE | EXTEND, "C:\\w\\a.txt", ms=50),
        rec(7, CLOSE | EXTEND, "C:\\w\\a.exe", ms=810), rec(8, CLOSE | EXTEND, "D:\\x.exe", ms=60, volume="D:"),
    ]
    options = WatchOptions(rules=(Rule("regex", r"C:\Noise\.*"),), extensions=("pe",), volumes=("C",))
    got = {r.usn: (r.kind, r.path, r.renamed_from) for r in replay(records(rows), options).collect()}
    assert got == {
        2: ("Modified", "C:\\w\\a.exe", None), 3: ("Modified", "c:\\w\\a.exe", None),
        5: ("Renamed", "C:\\w\\b.exe", "C:\\Noise\\b.exe"), 7: ("Modified", "C:\\w\\a.exe", None),
    }
    late = replay(records(rows), WatchOptions(start_ts="2024-01-01 00:00:00.055", include_self=True))
    assert sorted(r.usn for r in late.collect()) == [7, 8]


@pytest.mark.parametrize("spans", [1, 5])
def test_throttle_of_one_hot_key(spark, spans):
    """Eight of ten records on one key, each within a window of the one before: one long run of open spans."""
    rng = random.Random(spans)
    times, at = [], 1_700_000_000_000
    for _ in range(1500):
        at += rng.choice([100, 250, 399, 400, 650, 799])
        times.append(at)
    rows = [(n, t, "hot" if n % 10 < 8 else f"p{n % 7}") for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "usn long, ms long, path string").select(
        "usn", F.timestamp_millis("ms").alias("ts"), F.lit("C:").alias("volume"), F.lit(1).alias("frn"), F.lit("Modified").alias("kind"), "path"
    )
    want, last = set(), {}
    for n, t, p in rows:
        if p not in last or t - last[p] >= 800:
            last[p] = t
            want.add(n)
    assert {r.usn for r in throttle(df, 800, windows_per_span=spans).collect()} == want


def test_maps_are_composed_in_few_rounds(spark):
    """A run of 200 maps that all depend on the one before: what comes out is the walk from its start."""
    rng = random.Random(3)
    rows, last = [], {}
    for key, length in (("a", 200), ("b", 1), ("c", 37)):
        state = NEVER
        for span in range(length):
            enter = [NEVER, *sorted(rng.sample(range(1000), 5))]
            leave = [rng.choice([NEVER, *range(0, 1000, 7)]) for _ in enter]
            rows.append((key, span, enter, leave))
            state = leave[max(i for i, e in enumerate(enter) if e <= state)]
            last[key, span] = state
    maps = spark.createDataFrame(rows, "key string, _span long, enter array<long>, leave array<long>")
    got = composed(maps, ("key",)).collect()
    assert {(r.key, r._span): r.leave for r in got} == {k: [v] for k, v in last.items()}
