"""Helpers the operators share: stored tables, bounded label samples, columns added in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from driftledger.sources.workdir import fresh_path

#: Bytes of text that are looked at together inside a task.
CHUNK = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, about. Spark's own bound is 64 MB, and the buffers of a
#: batch are held several times over, by the executor and by each of its workers.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words of the contracts that count them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back.

    Cuts the lineage, so a lost executor costs a reread and no recomputation.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold about ``BATCH_BYTES`` from now on, unless the session names a size itself."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def hashed_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if there are no more), the same ones in every run."""
    rows = df.count()
    if rows <= bound:
        return df
    # 53 bits of the hash as a fraction
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 11) / F.lit(float(1 << 53))
    return df.where(unit < bound / rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1]] if len(offsets) else data, offsets - first


def row_chunks(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``chunk`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def add_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[StructField],
    compute: Callable[..., list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with the columns ``compute`` makes of each Arrow batch's ``inputs``.

    ``keep`` names the columns that go on (all, by default); a new column replaces one of its name.
    """
    made = {f.name for f in fields}
    kept = [f for f in df.schema if f.name not in made and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            new = compute(*(batch.column(c) for c in inputs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + new, names + [f.name for f in fields]
            )

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, StructType(kept + fields))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        # a chunk's worth as a rule; a longer row has room to spare
        size = CHUNK + 1 if n <= CHUNK + 1 else n + n // 4
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by differences of one running polynomial."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


class Words:
    """Words of a run of rows: owning row, span and hash of each; bytes that separate are zero in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
        self.data = kinds[data]
        inside = self.data != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[first] = inside[first]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stops[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hash = span_hashes(self.data, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``n`` consecutive words, and whether they lie in one row."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = self.hash[:size].copy()
        for k in range(1, n):
            out = out * _BASE + self.hash[k : k + size]
        return mix(out), self.row[:size] == self.row[n - 1 :]

    def text(self, first: int, n: int) -> bytes:
        """``n`` words from ``first`` on, joined by blanks."""
        raw = self.data[self.starts[first] : self.ends[first + n - 1]].tobytes()
        return b" ".join(x for x in raw.split(b"\0") if x)


def byte_kinds(separators: list[tuple[int, int]]) -> np.ndarray:
    """Table of what a byte counts as: zero if it separates words, lower-cased if it is A-Z."""
    kinds = np.arange(256, dtype=np.uint8)
    kinds[0x41:0x5B] += 0x20
    for low, high in separators:
        kinds[low : high + 1] = 0
    return kinds


#: Words between ASCII white space.
SPACED = byte_kinds([(0x20, 0x20), (0x09, 0x0D), (0, 0)])
#: Words of ASCII letters, digits and anything outside ASCII; upper case is lowered first.
ALNUM = byte_kinds([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
