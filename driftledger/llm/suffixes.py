"""Removal of long repeated byte strings by suffix arrays.

Common prefixes are derived on a Burrows-Wheeler transform by breadth-first backward extension of
intervals, in order of increasing value, up to the minimum length: boundaries that are still open then
have common prefixes at least that long.

To spread the work, every string of ``length`` bytes is attributed to the least k-gram hash inside it,
its anchor. Equal strings have equal anchors, so only strings of one anchor have to be compared.
Consecutive strings with one anchor form a context; only contexts whose anchor occurs more than once
are looked at, equal contexts once, and each shard of the transform holds whole anchors. A context that
occurs again repeats as a whole; it is transformed only where single contexts share its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .common import add_columns, mix, powers, row_chunks, sliding_min, stored, utf8

LENGTH, KGRAM = 400, 64
#: Strings per context at most; bytes transformed together; bytes of a text looked at together.
RUN, BATCH, PIECE = 512, 2 << 20, 1 << 20
#: An anchor with more distinct contexts is compared string by string, so that Spark can split it.
HOT = 4096


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kgram: int = KGRAM):
    """Contexts of a run of texts: owning row, first string, number of strings, anchor, how often the
    anchor occurs in the context itself."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    grams = mix((total[kgram:] - total[:-kgram]) * down[: len(total) - kgram])
    least = sliding_min(grams, length - kgram + 1)
    # strings that end inside the row they begin in
    reach = offsets[1:] - length + 1
    first = offsets[:-1]
    keep = first < reach
    first, reach, rows = first[keep], reach[keep], np.flatnonzero(keep)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.unique(np.concatenate([change, first]))
    row = np.searchsorted(first, starts, side="right") - 1
    inside = (row >= 0) & (starts < reach[np.maximum(row, 0)])
    starts, row = starts[inside], row[inside]
    ends = np.minimum(np.append(starts[1:], len(least)), reach[row])
    # a hash that repeats in a row makes long runs
    parts = -(-(ends - starts) // RUN)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, ends, row = (np.repeat(x, parts) for x in (starts, ends, row))
    starts = starts + RUN * turn
    ends = np.minimum(starts + RUN, ends)
    anchors = least[starts]
    # k-grams that may be an anchor, by some bits of their hash; then those of each context
    table = np.zeros(1 << 20, bool)
    table[anchors & np.uint64(0xFFFFF)] = True
    places = np.flatnonzero(table[grams & np.uint64(0xFFFFF)])
    low, high = np.searchsorted(places, starts), np.searchsorted(places, ends + length - kgram)
    own = np.repeat(np.arange(len(starts)), high - low)
    at = np.arange(len(own)) - np.repeat(np.cumsum(high - low) - high, high - low)
    occurs = np.bincount(own[grams[places[at]] == anchors[own]], minlength=len(starts))
    return rows[row], starts - offsets[rows[row]], ends - starts, anchors, occurs


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of rows of about a piece, and overlapping pieces of longer rows: data, offsets, first row, shift."""
    for low, high in row_chunks(offsets, PIECE):
        own = offsets[low : high + 1]
        if high - low > 1 or own[1] - own[0] <= 2 * PIECE:
            yield data[own[0] : own[-1]], own - own[0], low, 0
            continue
        for at in range(int(own[0]), int(own[1]) - length + 1, PIECE):
            part = data[at : min(at + PIECE + length - 1, own[1])]
            yield part, np.array([0, len(part)]), low, at - int(own[0])


def contexts(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """Every context of every text: its document, anchor ``h``, digest ``d1``, ``d2``, and place."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("key")
            for part, own, low, shift in _segments(data, offsets, length):
                row, start, n, h, m = anchor_runs(part, own, length, kgram)
                body = memoryview(part)
                begin = own[row] + start
                digests = b"".join(
                    xxhash.xxh3_128_digest(body[a:b])
                    for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())
                )
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                at = pa.array(row + low)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(pair[:, 0])),
                     pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(start + shift, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(m, pa.int64())],
                    ["doc_id", "key", "h", "d1", "d2", "s", "n", "m"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key long, h long, d1 long, d2 long, s long, n long, m long")


def suffix_order(
    symbols: np.ndarray, left: np.ndarray, depth: int, bits: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols at least, then by place; ranks; common prefixes below ``seed``.

    ``left`` is the number of symbols before the suffix's terminator; terminators (0) are all different.
    Symbols have ``bits`` bits; the first sort key packs ``seed`` of them.
    """
    n = len(symbols)
    key, packed = symbols.astype(np.int64), 1
    while packed < seed:
        more = min(packed, seed - packed)
        # the next symbols, unless the text ends before them
        rest = np.zeros(n, np.int64)
        rest[: n - packed] = key[packed:] >> (bits * (packed - more))
        rest[left < packed] = 0
        key <<= bits * more
        key |= rest
        packed += more
    order = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key, sorted_left = key[order], left[order]
    low = np.full(n + 1, -1, np.int16)
    differ = sorted_key[1:] ^ sorted_key[:-1]
    same = np.full(n - 1, seed, np.int16)
    for j in range(seed - 1, -1, -1):
        same[differ >> (bits * (seed - 1 - j)) != 0] = j
    same = np.minimum(same, np.minimum(sorted_left[1:], sorted_left[:-1])).astype(np.int16)
    low[1:n][same < seed] = same[same < seed]
    low[0] = low[n] = 0
    # refine groups that are still equal by the rank of what follows
    fresh = np.ones(n, bool)
    fresh[1:] = same < seed
    first = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = first
    known = seed
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    while known < depth and tied.any():
        at = np.flatnonzero(tied)
        own = order[at]
        pair = first[at].astype(np.int64) << 32 | rank[own + known]
        sort = np.argsort(pair, kind="stable")
        order[at] = own[sort]
        pair = pair[sort]
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        first[at] = np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32)
        rank[order[at]] = first[at]
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied[at[alone]] = False
        known *= 2
    rank[order] = np.arange(n, dtype=np.int32)
    return order, rank, low


def open_boundaries(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place of the joined texts whether the ``length`` bytes from it also start elsewhere.

    Also returns where each text begins and its size.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n, ends = len(raw), begins + sizes
    used = np.bincount(raw, minlength=256) > 0
    symbols = np.cumsum(used).astype(np.uint16)[raw]
    symbols[ends] = 0
    bits = int(used.sum()).bit_length()
    seed = min(63 // bits, 16, length - 1)
    left = (np.repeat(ends, sizes + 1) - np.arange(n)).astype(np.int32)
    order, rank, common = suffix_order(symbols, left, length + 1, bits, seed)
    before = np.where(order > 0, rank[order - 1], -1).astype(np.int32)  # backward step
    head = symbols[order]  # first symbol of each suffix
    # intervals of seed symbols whose right boundary has just been found
    cut = np.flatnonzero(common >= 0)
    new = np.flatnonzero(common[cut] == seed - 1)
    new = new[(new > 0) & (new < len(cut) - 1)]
    low, high = cut[new - 1], cut[new]
    for value in range(seed, length):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        step = before[at]
        sort = np.argsort(step, kind="stable")
        step, owner = step[sort], owner[sort]
        owner, step = owner[step >= 0], step[step >= 0]
        if not len(step):
            break
        apart = np.ones(len(step), bool)
        apart[1:] = (step[1:] != step[:-1] + 1) | (owner[1:] != owner[:-1]) | (head[step[1:]] != head[step[:-1]])
        begin = np.flatnonzero(apart)
        low, high = step[begin].astype(np.int64), step[np.append(begin[1:], len(step)) - 1].astype(np.int64) + 1
        still = common[high] < 0
        low, high = low[still], high[still]
        common[high] = value
    shared = common < 0  # a common prefix of length bytes or more
    again = np.empty(n, bool)
    again[order] = shared[:-1] | shared[1:]
    return again, begins, sizes


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    yield from zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())


def _search(rows: list[tuple], length: int) -> pa.RecordBatch:
    again, begins, sizes = open_boundaries([text for *_, text in rows], length)
    out = []
    for (h, d1, d2, count, _), begin, size in zip(rows, begins.tolist(), sizes.tolist()):
        if count == 1:  # a context that occurs more often repeats as a whole
            out.extend((h, d1, d2, a, b - a) for a, b in _runs(again[begin : begin + size - length + 1]))
    columns = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "d1", "d2", "off", "len"])


def _shards(length: int):
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= BATCH and row[0] != rows[-1][0]:
                    yield _search(rows, length)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4]) + 1
        if rows:
            yield _search(rows, length)

    return run


_FOUND = "h long, d1 long, d2 long, off long, len long"


def _bodies(docs: DataFrame, picked: DataFrame, length: int) -> DataFrame:
    """``picked`` contexts with their bytes, cut out of one document that has them."""
    wanted = picked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "d1", "d2", "c", "s", "n")).alias("parts"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "text")
    joined = texts.join(
        wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    ).select("text", "parts")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            body = memoryview(data)
            for begin, parts in zip(offsets.tolist(), batch.column("parts")):
                p = parts.values.flatten()
                cut = [
                    bytes(body[begin + s : begin + s + n + length - 1])
                    for s, n in zip(p[4].to_pylist(), p[5].to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*p[:4], pa.array(cut, pa.binary())], ["h", "d1", "d2", "c", "body"])

    return joined.mapInArrow(run, "h long, d1 long, d2 long, c long, body binary")


def _by_string(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated strings of hot anchors' single contexts, counted one by one by 128 bits of hash."""

    def run(batches):
        for batch in batches:
            for h, d1, d2, c, body in zip(*(x.to_pylist() for x in batch.columns)):
                n = len(body) - length + 1
                pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[k : k + length]) for k in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * n, pa.int64()) for x in (h, d1, d2, c)]
                    + [pa.array(np.arange(n)), pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))],
                    ["h", "d1", "d2", "c", "off", "w1", "w2"],
                )

    each = stored(bodies.mapInArrow(run, "h long, d1 long, d2 long, c long, off long, w1 long, w2 long"), "hot-strings")
    many = each.groupBy("w1", "w2").agg(F.sum("c").alias("all")).where("all >= 2")
    once = each.where("c = 1").join(many, ["w1", "w2"], "left_semi")
    return once.select("h", "d1", "d2", "off", F.lit(1).cast("long").alias("len"))


def recurring(every: DataFrame) -> DataFrame:
    """Contexts whose anchor occurs more than once.

    Anchors are written first: a join right on top of their aggregate would keep all contexts of a common
    passage in one task, while two sides of their own are split (or the anchors broadcast) as the join runs.
    """
    anchors = every.groupBy("h").agg(F.sum("m").alias("c")).where("c >= 2")
    return every.join(stored(anchors.select("h"), "repeated-anchors"), "h", "left_semi")


def repeated_spans(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``key`` and ``spans`` (start, end of repeated bytes) of documents that have any.

    ``docs`` has ``doc_id``, ``key`` (a hash of the text) and ``text`` without nulls.
    """
    every = stored(contexts(docs, length, kgram), "contexts")
    again = stored(recurring(every), "repeated-contexts")
    # any holder will do: equal digests are equal bytes
    held = [F.first(c).alias(c) for c in ("doc_id", "key", "s", "n")]
    distinct = stored(again.groupBy("h", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), *held), "distinct-contexts")
    # a context that occurs again repeats as a whole; anchors with a single context are still to be compared
    anchored = distinct.groupBy("h").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + length).alias("size"), F.min("c").alias("least")
    )
    anchored = stored(anchored.where("least = 1").select("h", "size", (F.col("m") > hot).alias("hot")), "open-anchors")
    size, split = anchored.agg(F.sum(F.when(~F.col("hot"), F.col("size"))), F.max("hot")).first()
    shards = max(1, -(-(size or 0) // (2 * BATCH)))
    whole = distinct.where("c > 1").select("h", "d1", "d2", F.lit(0).cast("long").alias("off"), F.col("n").alias("len"))
    calm = distinct.join(anchored.where(~F.col("hot")), "h", "left_semi")
    found = (
        _bodies(docs, calm, length).repartition(int(shards), "h").sortWithinPartitions("h")
        .mapInArrow(_shards(length), _FOUND)
    )
    found = found.unionByName(whole)
    if split:
        crowded = distinct.join(anchored.where("hot"), "h", "left_semi")
        found = found.unionByName(_by_string(_bodies(docs, crowded, length), length))
    start = F.col("s") + F.col("off")
    return (
        again.join(found, ["h", "d1", "d2"])
        .select("doc_id", "key", F.struct(start.alias("start"), (start + F.col("len") + length - 1).alias("end")).alias("span"))
        .groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", kgram: int = KGRAM, hot: int = HOT
) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (binary).

    Texts are taken as UTF-8 bytes, null as none. A byte goes if a string of ``length`` bytes that also
    starts anywhere else covers it, in the same document or another; all is judged on the input. What
    is left may be no valid UTF-8, so it is binary. Repeated rows are documents of their own and remove
    each other's text; an empty table gives no row.
    """
    if not 0 < kgram <= length:
        raise ValueError("kgram must lie between 1 and length")
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("key"))
    spans = repeated_spans(own, length, kgram, hot).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    joined = joined.select(F.col("doc_id").alias(doc_id), "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def compute(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(texts)
        rows = []
        for a, b, s, e in zip(offsets.tolist(), offsets[1:].tolist(), starts, ends):
            raw = data[a:b]
            if s.is_valid:
                mark = np.zeros(len(raw) + 1, np.int64)
                np.add.at(mark, s.values.to_numpy(), 1)
                np.add.at(mark, e.values.to_numpy(), -1)
                gone = np.cumsum(mark[:-1]) > 0
                kept, n = raw[~gone].tobytes(), sum(1 for _ in _runs(gone))
            else:
                kept, n = raw.tobytes(), 0
            rows.append((b - a, b - a - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [[]] * 5
        return [
            *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())
        ]

    fields = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields += [StructField("kept_sha256", StringType()), StructField("kept", BinaryType())]
    return add_columns(joined, ["text", "starts", "ends"], fields, compute, [doc_id])
