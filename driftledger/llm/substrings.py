"""Removal of repeated word sequences by level-wise doubling.

First all windows of a short length are compared. Only windows that repeat go on: where one that repeats is
followed by another, both make a window of twice the length, and so on up to the wanted length or until no
candidate is left. At the last level every group of equal windows keeps its earliest one.

Windows are compared by hashes of words that are dealt to slots by their value. A chunk of texts sends a
slot its share as packed arrays, each hash once; the slot answers which of them other chunks have too, and the
chunk's windows of the next level are made from the answers alone, without the texts. The hashes grow with the
input, so that equal hashes stand for equal windows at any size (below a chance of 2**-9 for a whole run).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .common import _BASE, Words, add_columns, mix, row_chunks, stored, utf8

LENGTH, BASE = 20, 10
#: Bytes of text a slot answers for, about; least and most bytes of a chunk; bytes of a chunk per slot.
SLOT, CHUNK, SLICE = 16 << 20, (1 << 19, 1 << 25), 512
#: Bytes that separate words are zero; a zero byte in a text is a letter like any other.
_KINDS = np.arange(256, dtype=np.uint8)
_KINDS[0] = 0xFF
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_ROW = "slot int, chunk long, part int, key binary, at binary, ids binary, starts binary"
_NAMES = ["slot", "chunk", "part", "key", "at", "ids", "starts"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
#: Kinds of rows by ``part``: a chunk's documents, windows it knows to repeat by itself, answers; shares have 0.
HEADER, LOCAL, ANSWER, SHARE = -3, -2, -1, 0
_MANY = np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray, size: int = 8) -> bytes:
    """The lowest ``size`` bytes of each value, all first bytes first: bytes that hardly differ compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unpack(packed: bytes, size: int = 8) -> np.ndarray:
    out = np.zeros((len(packed) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(packed, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    """``pack`` of the steps between ascending values, which are small."""
    return pack(np.diff(values, prepend=0), 4)


def unpack_rising(packed: bytes, size: int = 4) -> np.ndarray:
    return np.cumsum(unpack(packed, size).astype(np.int64))


def lengths_of(length: int, base: int) -> list[int]:
    """Window lengths from ``base`` on, doubled up to ``length``."""
    found = [min(base, length)]
    while found[-1] < length:
        found.append(min(2 * found[-1], length))
    return found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _shares(slot: np.ndarray, chunk: int, key: np.ndarray, at: np.ndarray, bytes_: int, more=()) -> list[tuple]:
    """A row per slot with its part of the arrays."""
    order = np.argsort(slot, kind="stable")
    own, begin = np.unique(slot[order], return_index=True)
    out = []
    for s, some in zip(own.tolist(), np.split(order, begin[1:])):
        out.append((s, chunk, SHARE, pack(key[some], bytes_), pack_rising(at[some]), *(pack(x[some]) for x in more)))
        if not more:
            out[-1] += (None, None)
    return out


def _first_level(width: int, slots: int, size: int, chunk_bytes: int):
    """Shares of the windows of ``width`` words of every chunk, and a header with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, k1, k2 = (batch.column(c).to_numpy() for c in ("id", "k1", "k2"))
            for low, high in row_chunks(offsets, chunk_bytes):
                own = offsets[low : high + 1]
                words = Words(data[own[0] : own[-1]], own - own[0], _KINDS)
                gram, whole = words.grams(width)
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                header = tuple(pack(x[low:high].view(np.uint64)) for x in (ids, k1, k2))
                rows = [(chunk % slots, chunk, HEADER, header[0], pack(words.bounds), header[1], header[2])]
                gram = gram[at]
                slot = ((gram >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)
                value = gram & np.uint64((1 << 8 * size) - 1)
                name = value ^ (slot.astype(np.uint64) << np.uint64(40))
                _, first, number, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[number] > 1)
                if len(again):  # the chunk itself repeats them
                    rows.append((chunk % slots, chunk, LOCAL, pack(name[again]), pack_rising(at[again]), None, None))
                first = np.sort(first)
                yield _batch(rows + _shares(slot[first], chunk, value[first], at[first], size))
                chunk += 1

    return run


def _by(column: str, close: Callable[[list[dict]], list[tuple]]):
    """Rows sorted by ``column``: each group's rows together to ``close``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row[column] != held[0][column]:
                    out += close(held)
                    held = []
                held.append(row)
            if out:
                yield _batch(out)
        if held:
            yield _batch(close(held))

    return run


def _join(rows: list[dict], column: str, size: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column, and the number of the row each comes from."""
    parts = [unpack_rising(r[column]) if column == "at" else unpack(r[column], size) for r in rows]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _answers(rows: list[dict], size: int, last: bool) -> list[tuple]:
    """What a slot answers each chunk: its windows that repeat; at the last level those that came earlier elsewhere."""
    slot = rows[0]["slot"]
    out = [tuple(r[c] for c in _NAMES) for r in rows if r["part"] != SHARE]
    rows = [r for r in rows if r["part"] == SHARE]
    if not rows:
        return out
    key, owner = _join(rows, "key", size)
    if last:
        ids, starts = (_join(rows, c)[0].view(np.int64) for c in ("ids", "starts"))
        order = np.lexsort((starts, ids, key))
    else:
        order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    if last:
        begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        found = np.sort(order[(ids[order] != ids[order[begin]]) | (starts[order] != starts[order[begin]])])
    else:
        found = np.sort(order[~(fresh & np.append(fresh[1:], True))])
    if not len(found):
        return out
    at = _join(rows, "at")[0][found]
    name = key[found] ^ np.uint64(slot << 40) if size < 8 else key[found]
    cut = np.flatnonzero(np.append(True, owner[found][1:] != owner[found][:-1]))
    for some in np.split(np.arange(len(found)), cut[1:]):
        chunk = rows[owner[found[some[0]]]]["chunk"]
        out.append((slot, chunk, ANSWER, None if last else pack(name[some]), pack_rising(at[some]), None, None))
    return out


def _windows_of(rows: list[dict]) -> tuple[dict, np.ndarray, np.ndarray]:
    """A chunk's header, and the places and names of its windows that repeat, by place."""
    header = next(r for r in rows if r["part"] == HEADER)
    rest = [r for r in rows if r["part"] != HEADER]
    if not rest:
        return header, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, once = np.unique(_join(rest, "at")[0], return_index=True)
    name = _join(rest, "key")[0][once] if rest[0]["key"] is not None else np.zeros(len(at), np.uint64)
    return header, at, name


def _double(step: int, slots: int, last: bool):
    """Candidates of the next length: windows that repeat and are followed, ``step`` words on, by one that does."""

    def close(rows: list[dict]) -> list[tuple]:
        header, at, name = _windows_of(rows)
        chunk, home = header["chunk"], header["chunk"] % slots
        out = [(home, chunk, HEADER, *(header[c] for c in _NAMES[3:]))]
        bounds = unpack(header["at"]).astype(np.int64)
        follow = np.searchsorted(at, at + step)
        both = follow < len(at)
        both[both] = at[follow[both]] == at[both] + step
        row = np.searchsorted(bounds, at, side="right") - 1
        both[both] = row[follow[both]] == row[both]
        at, row, one, two = at[both], row[both], name[both], name[follow[both]]
        if not len(at):
            return out
        key = mix(one * _BASE + two)
        slot = ((mix(two * _MANY + one) >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)
        if not last:
            _, first, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[number] > 1)
            if len(again):
                out.append((home, chunk, LOCAL, pack(key[again]), pack_rising(at[again]), None, None))
            first = np.sort(first)
            return out + _shares(slot[first], chunk, key[first], at[first], 8)
        ids = unpack(header["key"]).view(np.int64)[row]
        starts = at - bounds[row]
        order = np.lexsort((starts, ids, key))
        fresh = np.append(True, key[order][1:] != key[order][:-1])
        begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = np.sort(order[(ids[order] != ids[order[begin]]) | (starts[order] != starts[order[begin]])])
        if len(later):  # the chunk itself has an earlier one
            out.append((home, chunk, LOCAL, None, pack_rising(at[later]), None, None))
        # rows of one id and start that are equally early all wait for the answer
        wait = np.setdiff1d(np.arange(len(at)), later)
        more = (ids[wait].view(np.uint64), starts[wait])
        return out + _shares(slot[wait], chunk, key[wait], at[wait], 8, more)

    return _by("chunk", close)


def _spans(length: int):
    """Per document the runs of words that its later windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[dict]) -> list[tuple]:
            header, at, _ = _windows_of(rows)
            if not len(at):
                return []
            bounds = unpack(header["at"]).astype(np.int64)
            row = np.searchsorted(bounds, at, side="right") - 1
            own = [unpack(header[c]).view(np.int64) for c in ("key", "ids", "starts")]
            # windows of one row that overlap or touch make one run
            fresh = np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length))
            first = np.flatnonzero(fresh)
            begin, end = at[first], at[np.append(first[1:], len(at)) - 1] + length
            out = []
            cut = np.flatnonzero(np.append(True, row[first][1:] != row[first][:-1]))
            for some in np.split(np.arange(len(first)), cut[1:]):
                r = row[first[some[0]]]
                out.append((*(int(x[r]) for x in own), (begin[some] - bounds[r]).tolist(), (end[some] - bounds[r]).tolist()))
            return out

        for found in _groups(batches, "chunk"):
            rows = close(found)
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "k1", "k2", "begins", "ends"]
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != held[0][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def later_spans(keyed: DataFrame, length: int, base: int, slot_bytes: int = SLOT) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``begins``, ``ends``: runs of words to remove, of documents that have any."""
    session = keyed.sparkSession
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-total // slot_bytes))
    chunk = min(max(CHUNK[0], slots * SLICE), CHUNK[1])
    # bits of hash left beside the slot, for twice the bits that count the words and ten more
    size = min(8, max(4, -(-(int(total).bit_length() + 10 - int(slots).bit_length()) // 8)))
    if size > 5:
        size = 8
    parts = max(slots, min(8 * slots, int(session.conf.get("spark.sql.shuffle.partitions"))))
    lengths = lengths_of(length, base)
    rows = keyed.mapInArrow(_first_level(lengths[0], slots, size, chunk), _ROW)
    for level, width in enumerate(lengths):
        last = level == len(lengths) - 1
        if level:
            step = width - lengths[level - 1]
            rows = rows.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_double(step, slots, last), _ROW)
        answer = size if level == 0 else 8
        rows = rows.repartition(parts, "slot").sortWithinPartitions("slot")
        rows = rows.mapInArrow(_by("slot", lambda own, a=answer, z=last: _answers(own, a, z)), _ROW)
    spans = rows.repartition(parts, "chunk").sortWithinPartitions("chunk")
    return spans.mapInArrow(_spans(length), "id long, k1 long, k2 long, begins array<long>, ends array<long>")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", base: int = BASE,
    slot_bytes: int = SLOT,
) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (a text).

    Words are runs without ASCII white space, unchanged. A word goes if a window of ``length`` consecutive
    words covers it whose words also start earlier: in a document of smaller id (a whole number), or earlier
    in the same one. All is judged on the input. ``kept`` joins the words that stay by one space.

    Null and empty texts have no words, and texts of fewer than ``length`` lose none. Rows of one id are one
    document: of equal windows those of the least start stay, in each row that has them. Rows without id come
    after all others, as one document. An empty table gives no row; other columns are not looked at.
    """
    if not 0 < base < length:
        raise ValueError("base must lie between 1 and length - 1")
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias(doc_id), body.alias("text"))
    own = own.select(
        doc_id, "text", F.coalesce(F.col(doc_id), F.lit((1 << 63) - 1)).alias("_id"),
        F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit("text"), "text").alias("_k2"),
    )
    keyed = own.select(F.col("_id").alias("id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    spans = stored(later_spans(keyed, length, base, slot_bytes).dropDuplicates(["id", "k1", "k2"]), "repeated-words")
    joined = own.join(spans, (F.col("_id") == F.col("id")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")

    def compute(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> list[pa.Array]:
        rows = []
        for t, b, e in zip(texts, begins, ends):
            words = t.as_py().encode().split()
            kept = words
            if b.is_valid:
                kept, at = [], 0
                for low, high in zip(b.as_py(), e.as_py()):
                    kept += words[at:low]
                    at = high
                kept += words[at:]
            joined_words = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined_words).hexdigest(), joined_words.decode()))
        columns = list(zip(*rows)) or [[]] * 4
        return [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string()])]

    fields = [StructField(n, LongType()) for n in ("n_words", "n_removed")]
    fields += [StructField(n, StringType()) for n in ("kept_sha256", "kept")]
    return add_columns(joined.select(doc_id, "text", "begins", "ends"), ["text", "begins", "ends"], fields, compute, [doc_id])
