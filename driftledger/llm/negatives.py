"""Hard negatives by a secondary sort.

Scores of anchors with other rows are keyed by (anchor, descending score, id), dealt by anchor and sorted
inside the partitions. One pass over the sorted stream meets an anchor's positives first; each opens a
window of scores below its own, and the negatives that follow are given out to the windows they fall in.
No anchor's rows are ever held.

All scores of a table would be far too many to sort, so every task combines before the shuffle: of the rows
it reads it sends, per anchor, those that could be among the first positives, and then, per positive, those
that could be among the first in its window. Anchors are a stated query set that is matched with all rows in
blocks of bounded bytes, one broadcast at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Positives per anchor, negatives per positive, and the window in percent of the positive's score.
POSITIVES, NEGATIVES, WINDOW = 5, 3, (50, 95)
#: Bytes of anchor vectors that are broadcast together; scores a task computes together.
BLOCK, SCORES = 16 << 20, 1 << 22

_PAIR = "anchor_id long, other_id long, score long"
_NEVER = -np.inf


def usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and ``v`` (components times 256, rounded down) of rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    present = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    return df.where(F.coalesce(present, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v")
    )


def _vectors(batch: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the rows with vectors so long, and their matrix."""
    column = batch.column("v")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = at, flat[starts[at][:, None] + np.arange(d)].reshape(len(at), d)
    return out


class First:
    """The first ``k`` of each slot by descending score, then id, among all that was offered."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.floor = np.full(slots, _NEVER)
        self.slot, self.id, self.at = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """``scores`` has a row per slot and a column per row of the table; what is no candidate is ``-inf``."""
        least = self.floor[slots]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > _NEVER))
        if not len(row):
            return
        slot = np.concatenate([self.slot, slots[row]])
        score = np.concatenate([self.score, scores[row, col]])
        name = np.concatenate([self.id, ids[col]])
        place = np.concatenate([self.at, at[col]])
        order = np.lexsort((name, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        kept = order[rank < self.k]
        self.floor[slot[rank == self.k - 1]] = score[order[rank == self.k - 1]]
        self.slot, self.id, self.at, self.score = slot[rank < self.k], name[kept], place[kept], score[kept]


def _scan(rows: DataFrame, block: pa.Table, slots: int, k: int, candidates) -> DataFrame:
    """What each task's rows give to the anchors of ``block``: ``candidates`` masks a matrix of scores
    and yields (slots, scores)."""
    ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
    shared = rows.sparkSession.sparkContext.broadcast((ids, labels, _vectors(block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, own = shared.value
        best, seen = First(slots, k), 0
        for batch in batches:
            names, marks = (batch.column(c).to_numpy() for c in ("id", "label"))
            for d, (at, matrix) in _vectors(batch).items():
                if d not in own:
                    continue
                anchors, vectors = own[d]
                step = max(1, SCORES // len(at))
                for low in range(0, len(anchors), step):
                    some = anchors[low : low + step]
                    scores = vectors[low : low + step] @ matrix.T
                    scores[own_ids[some][:, None] == names[at]] = _NEVER  # an anchor is never its own partner
                    alike = own_labels[some][:, None] == marks[at]
                    for slot, part in candidates(some, scores, alike):
                        best.offer(slot, part, names[at], at + seen)
            seen += batch.num_rows
        # a row that several windows ask for goes once
        anchor = best.slot * len(own_ids) // max(slots, 1)
        _, once = np.unique(np.stack([anchor, best.at]), axis=1, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own_ids[anchor[once]]), pa.array(best.id[once]), pa.array(best.score[once].astype(np.int64))],
            ["anchor_id", "other_id", "score"],
        )

    return rows.mapInArrow(run, _PAIR)


def _positives(rows: DataFrame, block: pa.Table, k: int) -> DataFrame:
    def candidates(anchors, scores, alike):
        yield anchors, np.where(alike, scores, _NEVER)

    return _scan(rows, block, block.num_rows, k, candidates)


def _negatives(rows: DataFrame, block: pa.Table, positives: pa.Table, k: int, take: int, window) -> DataFrame:
    """Rows of other labels that could be among the first ``take`` of a positive's window."""
    ids = block.column("id").to_numpy()
    order = np.argsort(ids)
    anchor = order[np.searchsorted(ids[order], positives.column("anchor_id").to_numpy())]
    score = positives.column("score").to_numpy()
    # one window per anchor and place; those not used hold nothing
    bounds = np.full((2, len(ids), k), np.inf)
    bounds[1] = _NEVER
    by_anchor = np.argsort(anchor, kind="stable")
    anchor, score = anchor[by_anchor], score[by_anchor]
    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    bounds[0, anchor, place] = -((-window[0] * score) // 100)
    bounds[1, anchor, place] = (window[1] * score) // 100

    def candidates(anchors, scores, alike):
        apart = np.where(alike, _NEVER, scores)
        for j in range(k):
            low, high = (bounds[i, anchors, j][:, None] for i in (0, 1))
            yield anchors * k + j, np.where((apart >= low) & (apart <= high), apart, _NEVER)

    return _scan(rows, block, len(ids) * k, take, candidates)


def _windows(take: int, window: tuple[int, int]):
    """The pass over keys in order: positives open windows, negatives fall into those that still take some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened = None, []
        for batch in batches:
            out = []
            keys = batch.column("key")
            for a, falling, negative, other in zip(*(x.to_pylist() for x in keys.flatten())):
                if a != anchor:
                    anchor, opened = a, []
                if not negative:
                    opened.append([other, -falling, 0])
                    continue
                for w in opened:
                    if w[2] < take and window[0] * w[1] <= -100 * falling <= window[1] * w[1]:
                        w[2] += 1
                        out.append((a, w[0], w[2], other, w[1], -falling))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return run


def mine(
    df: DataFrame, anchors: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, take: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` is a condition on the table. An anchor's positives are its best ``positives`` other rows of
    the same label; a positive's negatives the best ``take`` rows of other labels whose score lies in
    ``window`` (percent of the positive's score, both ends included). A score is the exact inner product of
    the components times 256, rounded down; higher ones come first, ties go to the smaller id.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Vectors are
    compared with those of their length only; empty ones score 0. Rows with an anchor's id never answer it,
    and of several rows with its id the one with the least label and vector asks. Any other repeated row is a
    partner as often as it comes. Fewer partners give fewer rows, an anchor without any gives none, and an
    empty table stays empty. Other columns are not looked at. Scores are exact below 2**53.
    """
    rows = stored(usable(df, vec_id, vector, label), "negatives-rows")
    asked = usable(df.where(anchors), vec_id, vector, label)
    asked = stored(asked.groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.*"), "anchors")
    n, widest = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * max(widest or 1, positives) // block))

    def part(column: str, number: int):
        return F.pmod(F.xxhash64(F.lit("block"), column), F.lit(blocks)) == number

    def anchors_of(number: int) -> pa.Table:
        return asked.where(part("id", number)).toArrow()

    def all_blocks(build, name: str) -> DataFrame:
        """One pass over the table per block, each written by itself; a pass keeps only its own block."""
        found = [stored(build(b), f"{name}-{b}") for b in range(blocks)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    near = all_blocks(lambda b: _positives(rows, anchors_of(b), positives), "near")
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives).drop("_n")
    near = stored(near, "positives")
    far = all_blocks(
        lambda b: _negatives(
            rows, anchors_of(b), near.where(part("anchor_id", b)).toArrow(), positives, take, window
        ),
        "far",
    )
    pairs = near.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    key = F.struct("anchor_id", (-F.col("score")).alias("falling"), "negative", "other_id")
    return (
        pairs.select("anchor_id", key.alias("key"))
        .repartition("anchor_id").sortWithinPartitions("key").select("key")
        .mapInArrow(
            _windows(take, window),
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    )
