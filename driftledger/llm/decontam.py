"""Benchmark decontamination by winnowing.

The minimum hash of ``kgram`` words in every sliding window is a fingerprint, on both sides. Any span
of ``window`` shared words holds a fingerprint both sides chose, so documents are joined with test
items on fingerprints, and each hit is extended to the shared windows around it, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import ALNUM, Words, add_columns, row_chunks, sliding_min, utf8

#: Test text that is broadcast at once, in bytes; a larger benchmark is matched block by block.
BLOCK = 8 << 20
WINDOW, KGRAM = 13, 5


def chosen(words: Words, window: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the winnowed k-grams and their hashes. Ties keep every minimum."""
    grams, whole = words.grams(kgram)
    grams[~whole] = np.iinfo(np.uint64).max
    least = sliding_min(grams, window - kgram + 1)
    inside = words.row[: len(least)] == words.row[window - 1 : window - 1 + len(least)]
    keep = np.zeros(len(grams), bool)
    for k in range(window - kgram + 1):
        keep[k : k + len(least)] |= inside & (grams[k : k + len(least)] == least)
    places = np.flatnonzero(keep)
    return places, grams[places]


class TestBlock:
    """Windows of a block of test items and the fingerprints that lead to them."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int, kgram: int):
        self.window, self.kgram = window, kgram
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        self.windows: dict[bytes, set[int]] = {}
        short: dict[int, list[int]] = {}
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets, ALNUM)
        for k, (item, _) in enumerate(items):
            first, end = words.bounds[k], words.bounds[k + 1]
            n = min(int(end - first), window)
            if n:
                for at in range(first, end - n + 1):
                    self.windows.setdefault(words.text(at, n), set()).add(number[item])
            if 0 < n < window:
                short.setdefault(n, []).append(first)
        self.prints = np.unique(chosen(words, window, kgram)[1])
        self.short = {n: np.unique(words.grams(n)[0][at]) for n, at in short.items()}

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[int]]]:
        """First word, number of words and items of each occurrence of a window."""
        places, prints = chosen(words, self.window, self.kgram)
        places = places[_found(prints, self.prints)]
        # a shared window that chose this k-gram starts at most window - kgram words before it
        starts = np.unique((places[:, None] - np.arange(self.window - self.kgram + 1)).ravel())
        for n, at in [(self.window, starts), *((n, self._short(words, n)) for n in self.short)]:
            at = at[(at >= 0) & (at + n <= len(words.row))]
            at = at[words.row[at] == words.row[at + n - 1]]
            for first in at.tolist():
                items = self.windows.get(words.text(first, n))
                if items:
                    yield first, n, items

    def _short(self, words: Words, n: int) -> np.ndarray:
        grams, whole = words.grams(n)
        return np.flatnonzero(whole & _found(grams, self.short[n]))


def _found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _match(block) -> callable:
    def compute(texts: pa.Array, *before: pa.Array) -> list[pa.Array]:
        test = block.value
        data, offsets = utf8(texts)
        counts, spans, found = [], [], []
        old = [c.to_pylist() for c in before]
        for low, high in row_chunks(offsets):
            own = offsets[low : high + 1]
            words = Words(data[own[0] : own[-1]], own - own[0], ALNUM)
            counts.extend(np.diff(words.bounds).tolist())
            marks: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            for first, n, which in test.hits(words):
                row = int(words.row[first])
                at = first - int(words.bounds[row])
                marks.setdefault(row, []).append((at, at + n))
                items.setdefault(row, set()).update(which)
            for row in range(high - low):
                spans.append(marks.get(row, []))
                found.append([test.ids[k] for k in items.get(row, ())])
        if old:
            spans = [a + [(x["start"], x["end"]) for x in b] for a, b in zip(spans, old[0])]
            found = [a + b for a, b in zip(found, old[1])]
        spans = [_merged(x) for x in spans]
        return [
            pa.array(counts, pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS),
            pa.array([sorted(set(x)) for x in found], pa.list_(pa.string())),
        ]

    return compute


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    kgram: int = KGRAM,
    share: int = 20,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans``, ``item_ids``, ``n_hit`` and ``contaminated``.

    ``hit_spans`` are the merged runs of hit words (from, to) by word number, ``item_ids`` the items met,
    sorted as strings. An item of fewer than ``window`` words is matched whole; items without words or
    without an id match nothing; a null text has no words. Repeated rows are judged one by one, repeated
    items count once. ``contaminated``: a ``share``-th of the words at least is hit. Columns with the
    names made here are replaced; ``keep`` names the other columns that go on.

    The test side is split into blocks of about ``block`` bytes by a hash of the item, measured before
    anything is broadcast; documents pass the blocks one after the other and collect their hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    items = items.dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 64)).first()[0] or 0
    blocks = -(-size // block) or 1
    out = docs if keep is None else docs.select(*keep, *([] if text in keep else [text]))
    out = out.drop(*(c for c in ("n_words", "hit_spans", "item_ids", "n_hit", "contaminated") if c in out.columns))
    names = [c for c in (out.columns if keep is None else keep) if c in out.columns]
    span = StructField("hit_spans", ArrayType(_span_type()))
    fields = [StructField("n_words", LongType()), span, StructField("item_ids", ArrayType(StringType()))]
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        made = TestBlock([(r.id, r.text) for r in rows], window, kgram)
        before = ["hit_spans", "item_ids"] if k else []
        last = names if k == blocks - 1 else None
        out = add_columns(out, [text, *before], fields, _match(spark.sparkContext.broadcast(made)), last)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def _span_type():
    return StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


def items_digest(ids: list[str]) -> str:
    """What the query's ``items_sha256`` is, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
