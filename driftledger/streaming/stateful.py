"""Keyed state for streams: the last old name of a file, the last emission of a key.

State is one small row per file or key and is evicted by a wall-clock time to live, so no row is ever
dropped as late: records from before a key's last emission are throttled among themselves. A key's rows of one micro-batch are sorted before they meet the state; bound
the micro-batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) to bound them.

A call of a processor costs milliseconds whatever it is given, so files share calls: the key of a call is a
bucket of records or of files, and state is kept per file inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import values
from ..operators.events import event_columns, host_key, is_event
from ..operators.throttle import NEVER

_STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLIS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}

_TYPES = {"ts": "timestamp", "usn": "long", "frn": "long"}

# Buckets per shuffle partition: more of them even out the partitions, each costs a call per micro-batch.
_BUCKETS = 4

# A bucket's records of a micro-batch wait in up to so many stretches of time of so many records at least.
_STRETCHES, _STRETCH_ROWS = 16, 64


def _paired(columns: tuple[str, ...]) -> str:
    """Schema of events with their old names; what has no other type is a string."""
    return ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in columns)


def ttl_millis(text: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", text)
    if not found:
        raise ValueError(f"bad state lifetime '{text}', write for example '2 hours'")
    return int(found.group(1)) * _MILLIS[found.group(2)]


def set_up_state(df: DataFrame) -> None:
    """Session settings the keyed state needs, read when a query starts.

    State with a lifetime needs RocksDB. Such state asks for another micro-batch after every
    one, so batches without data are switched off: an ``availableNow`` run would never end.
    Expired state then goes with the next batch that has data.
    """
    conf = df.sparkSession.conf
    conf.set(_STATE_PROVIDER, _ROCKSDB)
    conf.set(_EMPTY_BATCHES, "false")


def _bucketed(df: DataFrame, *columns: str) -> GroupedData:
    """What shares a call: a few buckets per partition, by hash."""
    buckets = _BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")).groupBy("bucket")


class Hold(StatefulProcessor):
    """Records wait until the watermark has passed them; late ones go on at once.

    Every bucket lets go of the same stretch of time in the same micro-batch, so that what follows sees
    time in order over all keys. Waiting records lie in chunks, found by the timer of their earliest one; a
    chunk is a short stretch of time, so that only the chunks the watermark stands in are cut and kept again.
    """

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = [*columns, "at_us"]
        self.layout = pa.schema([*((c, pa.string()) for c in columns), ("at_us", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due_ms long", "records binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            yield from self._let_go(part[self.columns], passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due_ms = (expiredTimerInfo.getExpiryTimeInMs(),)
        held = self.waiting.getValue(due_ms)
        if held is None:
            return
        self.waiting.removeKey(due_ms)
        yield from self._let_go(self._read(held), timerValues.getCurrentWatermarkInMs())

    def _let_go(self, part: pd.DataFrame, passed: int) -> Iterator[pd.DataFrame]:
        due = part["at_us"] <= passed * 1000
        if due.any():
            yield part[due]
        for chunk in stretches(part[~due]):
            due_ms = -(-int(chunk["at_us"].iloc[0]) // 1000)
            held = self.waiting.getValue((due_ms,))
            if held is not None:
                chunk = pd.concat([self._read(held), chunk], ignore_index=True)
            self.waiting.updateValue((due_ms,), (self._written(chunk),))
            self.handle.registerTimer(due_ms)

    def _written(self, chunk: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.layout) as out:
            out.write_table(pa.Table.from_pandas(chunk, self.layout, preserve_index=False))
        return sink.getvalue().to_pybytes()

    def _read(self, held: tuple) -> pd.DataFrame:
        return pa.ipc.open_stream(pa.py_buffer(bytes(held[0]))).read_pandas()

    def close(self) -> None:
        pass


def stretches(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Records by time, cut where a grid of time is crossed; the grid is a power of two in microseconds."""
    if not len(part):
        return
    part = part.sort_values("at_us", kind="stable")
    at = part["at_us"].to_numpy()
    most = min(_STRETCHES, len(at) // _STRETCH_ROWS)
    cuts = []
    if most > 1:
        cell = at >> (int(at[-1] - at[0]) // most).bit_length()
        cuts = (np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist()
    for low, high in zip([0, *cuts], [*cuts, len(at)]):
        yield part.iloc[low:high]


def in_time_order(prepared: DataFrame, lateness: str, wanted: Column | None = None) -> DataFrame:
    """A stream whose micro-batches follow each other in record time.

    A record waits until one that is ``lateness`` younger has come, so records may arrive out of order by
    that much. Later ones are not lost, they only come out of order. The state is what arrives in
    ``lateness``; records behind the last watermark stay in it until newer ones come. Records without a
    time do not wait. All records move the clock; those that are not ``wanted`` go no further.
    """
    conf = prepared.sparkSession.conf
    conf.set(_STATE_PROVIDER, _ROCKSDB)
    columns = tuple(c for c in prepared.columns if c != "ts")
    types = dict(prepared.dtypes)
    # numbers wait as text: a missing one would turn a column of them into floats
    carried = [F.col(c).cast("string").alias(c) for c in columns]
    timed = prepared.withWatermark("ts", lateness)
    if wanted is not None:
        # the test of the time keeps the filter above the watermark, where all records have been seen
        timed = timed.filter(wanted | (F.unix_micros("ts") == F.lit(NEVER)))
    # without the time column itself no record counts as too late and is dropped
    timed = timed.select(*carried, F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at_us"))
    held = _bucketed(timed, *timed.columns).transformWithStateInPandas(
        statefulProcessor=Hold(columns),
        outputStructType=", ".join([*(f"{c} string" for c in columns), "at_us long"]),
        outputMode="Append",
        timeMode="EventTime",
    )
    at = F.timestamp_micros(F.nullif("at_us", F.lit(NEVER)))
    return held.select(*[at.alias(c) if c == "ts" else F.col(c).cast(types[c]).alias(c) for c in prepared.columns])


class LastOldName(StatefulProcessor):
    """Renamed rows get the latest earlier old name of their file; a call has the files of a bucket."""

    def __init__(self, ttl_ms: int, columns: tuple[str, ...]) -> None:
        self.ttl_ms = ttl_ms
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("old_names", "file string", "old string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values("usn", kind="stable")
        before, old = {}, {}
        found = []
        for file, path, carries in zip(batch["file"], batch["path"], batch["old_half"]):
            if file not in old:
                held = self.names.getValue((file,))
                before[file] = old[file] = held[0] if held else None
            found.append(old[file])
            if carries:
                old[file] = path
        for file, name in old.items():
            if name != before[file]:
                self.names.updateValue((file,), (name,))
        batch["renamed_from"] = pd.Series(found, index=batch.index, dtype=object)
        yield batch.loc[batch["kind"] == "Renamed", self.columns]

    def close(self) -> None:
        pass


class LastEmission(StatefulProcessor):
    """Leading-edge throttle on event time.

    Only records less than a window away from the last emission, before or after it, are its
    repeats. Older ones come late: none of them is lost, and repeats are dropped within the
    micro-batch that brings them. Records without a time are no events, as in the replay.
    """

    def __init__(self, window_us: int, ttl_ms: int) -> None:
        self.window_us = window_us
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_emission", "us long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["at_us"].notna()]
        if batch.empty:
            return
        batch = batch.sort_values(["at_us", "volume", "usn"], kind="stable")
        held = self.last.get()
        times = batch["at_us"].to_numpy()
        late, due = 0, 0
        if held:
            late = int(np.searchsorted(times, held[0] - self.window_us, side="right"))
            due = int(np.searchsorted(times, held[0] + self.window_us))
        keep = [*self._emissions(times[:late]), *(due + at for at in self._emissions(times[due:]))]
        if keep and (held is None or times[keep[-1]] > held[0]):
            self.last.update((int(times[keep[-1]]),))
        yield batch.iloc[keep].drop(columns=["at_us"])

    def _emissions(self, times: np.ndarray) -> Iterator[int]:
        at = 0
        while at < len(times):
            yield at
            at = int(np.searchsorted(times, times[at] + self.window_us))

    def close(self) -> None:
        pass


def pair_renames_stream(prepared: DataFrame, state_ttl: str, lateness: str | None = None) -> DataFrame:
    """Classified events of a stream, renames paired through keyed state.

    With ``lateness`` records come in order of time first. Renames and other events wait apart: a plan is a
    tree, so what both of them read is computed once for each.
    """
    set_up_state(prepared)
    old_half = values.has_bits(F.col("reason"), "RENAME_OLD_NAME")
    is_other = is_event(F.col("kind"), F.col("reason")) & (F.col("kind") != "Renamed")
    is_rename = (F.col("kind") == "Renamed") | old_half

    def of(wanted: Column) -> DataFrame:
        return (in_time_order(prepared, lateness, wanted) if lateness else prepared).filter(wanted)

    columns = event_columns(prepared)
    paired = (*columns, "renamed_from")
    others = of(is_other).select(*columns, F.lit(None).cast("string").alias("renamed_from"))
    file = F.to_json(F.struct("volume", "frn", *host_key(prepared)))
    renames = of(is_rename).select(*columns, old_half.alias("old_half"), file.alias("file"))
    renames = _bucketed(renames, "file").transformWithStateInPandas(
        statefulProcessor=LastOldName(ttl_millis(state_ttl), paired),
        outputStructType=_paired(paired),
        outputMode="Append",
        timeMode="ProcessingTime",
    )
    return others.unionByName(renames)


def throttle_stream(events: DataFrame, window_ms: int, state_ttl: str) -> DataFrame:
    """Throttle of a stream, keyed by path and kind, and by host where there is one."""
    set_up_state(events)
    ttl = max(ttl_millis(state_ttl), window_ms)
    return (
        events.withColumn("at_us", F.unix_micros("ts"))
        .groupBy("path", "kind", *host_key(events))
        .transformWithStateInPandas(
            statefulProcessor=LastEmission(window_ms * 1000, ttl),
            outputStructType=_paired(tuple(events.columns)),
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )
