"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as its bit counts per segment. The Manhattan distance of two embeddings is
a lower bound of the bits that differ, so pairs are found by a range join on a grid over the
embedding and verified on the fingerprints. Everything runs on distinct fingerprints: copies share
one, and are only looked up in the end.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import add_columns, stored, utf8

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Segments have two bits; the 32 counts form this many groups, of which DISTANCE can differ at most.
GROUPS = 6
_LOWER_A_Z = bytes(range(256)).lower()


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: the majority of the hashes of all word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER_A_Z).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
        spans = zip([0, *(e + 1 for e in ends[: len(words) - shingle])], ends[shingle - 1 :])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def with_fingerprints(
    docs: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a signed long; a null or empty text has 0."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(texts)
        body = memoryview(data)
        prints = [fingerprint(bytes(body[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]

    return add_columns(docs, [text], [StructField(name, LongType())], compute, keep)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _group_masks(groups: int) -> list[int]:
    """Bits of the packed two-bit counts that belong to each group of segments."""
    masks = [0] * groups
    for segment in range(32):
        masks[segment * groups // 32] |= 3 << (2 * segment)
    return masks


def bit_counts(fp: Column) -> Column:
    """The 32 counts of a fingerprint's two-bit segments, packed into a long."""
    low, high, ones = fp, F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    both = F.shiftleft(low.bitwiseAND(high).bitwiseAND(ones), 1)
    return both.bitwiseOR(low.bitwiseXOR(high).bitwiseAND(ones))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of packed two-bit counts, each 0 to 2.

    Adding 2 to every count of ``a`` and subtracting ``b`` gives values 0 to 4, kept apart by
    taking even and odd segments in turn; 2 means no difference.
    """
    even, two = F.lit(0x3333333333333333), F.lit(0x2222222222222222)
    total = F.lit(0)
    for shift in (0, 2):
        x = F.shiftrightunsigned(a, shift).bitwiseAND(even)
        y = F.shiftrightunsigned(b, shift).bitwiseAND(even)
        d = x + two - y
        one = F.lit(0x1111111111111111)
        # |d - 2| of d in 0..4: bit 0 set is a difference of 1, 0 and 4 are differences of 2
        odd = d.bitwiseAND(one)
        same = F.shiftrightunsigned(d, 1).bitwiseAND(one)
        total = total + F.bit_count(odd) + 2 * (F.lit(16) - F.bit_count(odd.bitwiseOR(same)))
    return total


def near_pairs(prints: DataFrame, fp: str = "fp", distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct fingerprints that differ in ``distance`` bits or fewer.

    At a Manhattan distance of ``distance`` or less, at most ``distance`` of the groups of segments
    differ, so some projection of the grid on the other groups puts both into one cell. Of the
    projections that do, only the first reports the pair.
    """
    masks = [_signed(m) for m in _group_masks(groups)]
    combos = list(combinations(range(groups), groups - distance))
    cells = [sum(_group_masks(groups)[g] for g in combo) for combo in combos]
    counts = bit_counts(F.col(fp))
    laid = prints.select(
        F.col(fp).alias("fp"),
        F.explode(
            F.array(*(
                F.struct(F.lit(k).alias("grid"), counts.bitwiseAND(F.lit(_signed(m))).alias("cell"))
                for k, m in enumerate(cells)
            ))
        ).alias("at"),
    ).select("fp", "at.grid", "at.cell")
    a, b = laid.alias("a"), laid.alias("b")
    pa_, pb_ = bit_counts(F.col("a.fp")), bit_counts(F.col("b.fp"))
    apart = pa_.bitwiseXOR(pb_)
    first = F.lit(True)
    for g in range(groups):
        # a group that agrees, is not in this projection and comes before its last: an earlier one reports
        earlier = [k for k, combo in enumerate(combos) if g not in combo and g < combo[-1]]
        if earlier:
            first &= ~F.col("a.grid").isin(earlier) | (apart.bitwiseAND(F.lit(masks[g])) != 0)
    return a.join(
        b,
        (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (manhattan(pa_, pb_) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance) & first,
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has an edge ``a`` - ``b``.

    Alternates large-star and small-star steps until nothing changes. Every step writes its edges to
    the shared folder; only counts and one checksum reach the driver.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = stored(small, label)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE
) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id reachable.

    Documents without words have fingerprint 0 and link like any other. Rows without an id carry the
    id of their component, null if no member has one. Repeated rows come back as often as they came.
    """
    prints = stored(with_fingerprints(docs.select(doc_id, text), text, keep=[doc_id]), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(doc_id).alias("first")), "fingerprint-nodes")
    found = components(near_pairs(nodes, distance=distance))
    member = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = member.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(doc_id, "fp", "component_id")
