"""Leading-edge throttle: drop repeats of a key less than a window after its last emission.

The rule is sequential within a key, and one key may hold a third of all rows, so a fold over
whole keys does not scale. It is cut into spans of time instead:

1. Timestamps are reduced to the distinct ones per key, before and after the shuffle; events are
   joined to the emitted ones at the end, so spans hold nothing but timestamps.
2. Every span collects its own timestamps plus the *halo*: those of the previous span's last
   window. Only an emission inside the halo can influence the span.
3. A span with an empty halo is independent. For the others, a vectorised helper maps every
   possible last emission in the halo to the last emission the span would end with.
4. Maps of neighbouring spans are composed pairwise: each round doubles the spans a map reaches
   back over, and a map that has become a single number takes no part any more. The rounds follow
   the logarithm of the longest run of spans that depend on each other; no key is walked.
5. Every span, its entry known, folds its own timestamps.

All groups are bounded by the number of distinct microseconds in a span, whatever the skew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import floor_div
from ..sources.workdir import fresh_path

# Windows per span: longer spans mean fewer boundaries, shorter ones smaller groups.
WINDOWS_PER_SPAN = 16

# Stands for "no emission that matters": far below any timestamp, without overflow.
NEVER = -(1 << 62)


def throttle(
    events: DataFrame,
    window_ms: int,
    key: tuple[str, ...] = ("path", "kind"),
    order: tuple[str, ...] = ("volume", "usn"),
    windows_per_span: int = WINDOWS_PER_SPAN,
) -> DataFrame:
    """Events that are emitted: at each chosen instant of a key, the first by ``order``."""
    window = window_ms * 1000
    width = window * windows_per_span
    rest = [c for c in events.columns if c not in key and c not in order]
    instants = events.groupBy(F.unix_micros("ts").alias("_us"), *key).agg(
        F.min(F.struct(*order, *rest)).alias("_first")
    )
    spans = _spans(events.select(F.unix_micros("ts").alias("_us"), *key).distinct(), window, width, key)
    entries = _entries(spans, window, width, key)
    own = F.filter("_times", lambda us: us >= F.col("_span") * F.lit(width))
    fold = F.aggregate(
        own,
        F.struct(F.coalesce("_entry", F.lit(NEVER)).alias("last"), F.array().cast("array<long>").alias("out")),
        lambda acc, us: F.when(
            us >= acc["last"] + F.lit(window), F.struct(us.alias("last"), F.array_append(acc["out"], us).alias("out"))
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    emitted = spans.join(entries, ["_span", *key], "left").select(*key, F.explode(fold).alias("_us"))
    return emitted.join(instants, ["_us", *key]).select(
        *[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in events.columns]
    )


def _spans(instants: DataFrame, window: int, width: int, key: tuple[str, ...]) -> DataFrame:
    """Timestamps of every span in order, its halo included; spans without own ones are dropped."""
    us = F.col("_us")
    span = floor_div(us, width)
    in_last_window = us >= (span + 1) * F.lit(width) - F.lit(window)
    members = F.when(in_last_window, F.array(span, span + 1)).otherwise(F.array(span))
    return (
        instants.withColumn("_span", F.explode(members))
        .groupBy("_span", *key)
        .agg(F.sort_array(F.collect_list("_us")).alias("_times"))
        .filter(F.element_at("_times", -1) >= F.col("_span") * F.lit(width))
    )


def _entries(spans: DataFrame, window: int, width: int, key: tuple[str, ...]) -> DataFrame:
    """Last emission before each span, where there is one that matters."""
    start = F.col("_span") * F.lit(width)
    has_halo = F.element_at("_times", 1) < start
    feeds_next = F.element_at("_times", -1) >= start + F.lit(width - window)
    maps = (
        spans.filter(has_halo | feeds_next)
        .select(*key, "_span", _transfer(window, width)("_span", "_times").alias("_map"))
        .select(*key, "_span", "_map.enter", "_map.leave")
    )
    return composed(maps, key).select(
        *key, (F.col("_span") + 1).alias("_span"), F.element_at("leave", 1).alias("_entry")
    ).filter(F.col("_entry") > NEVER)


def composed(maps: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``maps`` (``_span``, ``enter``, ``leave``), each composed with those of all adjacent spans before it.

    What comes before the first span of a run is ``NEVER``, so every map ends as one number. A round joins
    open maps, which reach back over as many spans as rounds have doubled, with those right before them.
    """
    current, reach = _written(maps, "maps"), 1
    while True:
        known = F.size("enter") == 1
        open_maps = current.filter(~known)
        if open_maps.isEmpty():
            return current
        before = current.select(
            *key, (F.col("_span") + reach).alias("_span"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave")
        )
        joined = open_maps.join(before, [*key, "_span"], "left")
        step = joined.select(
            *key, "_span", _after().alias("_map")
        ).select(*key, "_span", "_map.enter", "_map.leave")
        current, reach = _written(current.filter(known).unionByName(step), "maps"), 2 * reach


def _written(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, so that rounds do not pile up in one plan."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _after() -> Column:
    """The later map after the earlier one; after nothing, what it gives for ``NEVER``."""

    @F.pandas_udf("struct<enter: array<long>, leave: array<long>>")
    def after(enter: pd.Series, leave: pd.Series, enter_before: pd.Series, leave_before: pd.Series) -> pd.DataFrame:
        out_enter, out_leave = [], []
        for e, x, e0, x0 in zip(enter, leave, enter_before, leave_before):
            if e0 is None:
                e0 = x0 = np.array([NEVER])
            exits = np.asarray(x)[np.searchsorted(e, x0, side="right") - 1]
            steps = np.concatenate([[True], exits[1:] != exits[:-1]])
            out_enter.append(np.asarray(e0)[steps])
            out_leave.append(exits[steps])
        return pd.DataFrame({"enter": out_enter, "leave": out_leave})

    return after("enter", "leave", "_enter", "_leave")


def _transfer(window: int, width: int) -> Column:
    """Per span: possible last emissions before it, and the last emission each one leads to.

    Neighbouring entries with the same exit are stored once, by the first of them: orbits merge
    fast, so a dense halo shrinks to a few steps.
    """

    @F.pandas_udf("struct<enter: array<long>, leave: array<long>>")
    def transfer(span: pd.Series, times: pd.Series) -> pd.DataFrame:
        enter, leave = [], []
        for number, values in zip(span, times):
            entries, exits = span_map(np.asarray(values, dtype=np.int64), int(number), window, width)
            steps = np.concatenate([[True], exits[1:] != exits[:-1]])
            enter.append(entries[steps])
            leave.append(exits[steps])
        return pd.DataFrame({"enter": enter, "leave": leave})

    return transfer


def span_map(
    times: np.ndarray, span: int, window: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Entry candidates (``NEVER`` first) and the exit of each; ``NEVER`` if it cannot matter."""
    start, end = span * width, (span + 1) * width
    split = int(np.searchsorted(times, start))
    halo, own = times[:split], times[split:]
    entries = np.concatenate([[NEVER], halo])
    n = len(own)
    # following[i]: the emission after one at own[i]; an emission without one points to itself
    following = np.searchsorted(own, own + window)
    jump = np.where(following < n, following, np.arange(n))
    # an orbit emits at most once per window, so doubling ends after log2(width / window) rounds
    for _ in range(int(width // window).bit_length()):
        jump = jump[jump]
    first = np.searchsorted(own, entries + window)
    last = own[jump[np.minimum(first, n - 1)]]
    return entries, np.where((first < n) & (last >= end - window), last, NEVER)
