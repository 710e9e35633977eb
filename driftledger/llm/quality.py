"""Quality by importance resampling.

Target and raw text get generative models of hashed word unigrams and bigrams; a document's weight is
the ratio of its likelihoods, and documents are drawn without replacement, in proportion to their
weights, as the top of Gumbel-perturbed log weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from .common import SPACED, Words, add_columns, row_chunks, stored, utf8

#: Hashed n-grams of the two models.
WIDTH = 1 << 14
SMOOTHING = 1.0
#: Cells that ids are hashed to: so many a row, up to a bound (two bits each, 16 MB in all).
CELLS_PER_ROW, CELLS = 16, 1 << 26


def _buckets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Words and bigrams of a run of rows: owning row and hashed number."""
    words = Words(data, offsets, SPACED)
    pairs, whole = words.grams(2)
    row = np.concatenate([words.row, words.row[: len(pairs)][whole]])
    place = np.concatenate([words.hash, pairs[whole]]) >> np.uint64(65 - width.bit_length())
    return row, place.astype(np.int64)


def ngram_counts(docs: DataFrame, text: str = "text", width: int = WIDTH) -> np.ndarray:
    """How often each hashed n-gram occurs in all texts; every task sends its sums only."""

    def run(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in row_chunks(offsets):
                own = offsets[low : high + 1]
                _, place = _buckets(data[own[0] : own[-1]], own - own[0], width)
                total += np.bincount(place, minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["place", "n"])

    sums = docs.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(width, np.int64)
    for r in sums.collect():
        out[r.place] = r.n
    return out


def _bit(bits: str, place: Column) -> Column:
    """Whether bit ``place`` of the bitmap is set."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def good_texts(
    docs: DataFrame, good: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text", bound: int = CELLS
) -> tuple[DataFrame, DataFrame]:
    """Id and text of the documents whose id is in ``good`` (distinct): those told where they are read, and the rest.

    Ids alone are joined. They are hashed to cells, and two bitmaps tell which cells hold good ids and
    which others. A document in a cell of good ids only is good, in one without any it is not; only the
    texts of mixed cells are joined by id. Past the bound, more cells are mixed and more texts move.
    """
    cells = max(1, min(bound, CELLS_PER_ROW * rows))
    cell = F.pmod(F.xxhash64(doc_id), F.lit(cells)) + 1
    known = docs.where(F.col(doc_id).isNotNull())
    told = known.select(doc_id).distinct().join(good.withColumn("_good", F.lit(True)), doc_id, "left")
    place = F.bitmap_bit_position("_cell")
    maps = (
        told.select(F.bitmap_bucket_number(cell).alias("_map"), cell.alias("_cell"), "_good").repartition("_map").groupBy("_map")
        .agg(
            F.bitmap_construct_agg(F.when(F.col("_good"), place)).alias("_yes"),
            F.bitmap_construct_agg(F.when(F.col("_good").isNull(), place)).alias("_no"),
        )
    )
    maps = F.broadcast(stored(maps, "good-cells"))
    own = known.select(doc_id, text, F.bitmap_bucket_number(cell).alias("_map"), cell.alias("_cell")).join(maps, "_map")
    near = own.where(_bit("_yes", place))
    mixed = near.where(_bit("_no", place)).select(doc_id, text)
    # a semi-join would be pushed below the maps and move every text
    return near.where(~_bit("_no", place)).select(doc_id, text), mixed.join(good, doc_id)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per n-gram, smoothed by the raw distribution."""
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    strength = len(raw) * SMOOTHING
    return np.log((target + strength * share) / (target.sum() + strength)) - np.log(share)


def weights(docs: DataFrame, ratio: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``log_weight`` (log likelihood ratio of the whole text) and ``n_grams``; 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def compute(texts: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(texts)
        sums, counts = [], []
        for low, high in row_chunks(offsets):
            own = offsets[low : high + 1]
            row, place = _buckets(data[own[0] : own[-1]], own - own[0], len(shared.value))
            sums.append(np.bincount(row, shared.value[place], high - low))
            counts.append(np.bincount(row, minlength=high - low))
        joined = [np.concatenate(x) if x else np.zeros(0) for x in (sums, counts)]
        return [pa.array(joined[0], pa.float64()), pa.array(joined[1].astype(np.int64), pa.int64())]

    fields = [StructField("log_weight", DoubleType()), StructField("n_grams", LongType())]
    return add_columns(docs, [text], fields, compute, keep)


def gumbel_top(scored: DataFrame, k: int, doc_id: str = "doc_id", weight: str = "log_weight", seed: int = 7) -> DataFrame:
    """``scored`` with ``key`` (perturbed log weight) and ``selected``: the ``k`` highest keys.

    The noise is a hash of the id, so reruns agree. The k-th key is found by counting keys in ever
    finer ranges, 4096 counts at a time; nothing is sorted as a whole. Equal keys go by id, and of
    equal rows any is taken. ``k`` above the rows selects all.
    """
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) + 0.5) / F.lit(float(1 << 53))
    keyed = stored(scored.withColumn("key", F.col(weight) - F.log(-F.log(unit))), "gumbel")
    rows, low, high = keyed.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if k >= rows or not rows:
        return keyed.withColumn("selected", F.lit(True))
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    need, cells = k, 4096
    while high > low:
        cell = F.least(F.floor((F.col("key") - low) / F.lit((high - low) / cells)), F.lit(cells - 1))
        inside = keyed.where(F.col("key").between(low, high)).groupBy(cell.alias("cell"))
        counts = sorted(inside.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, least, most in counts:
            if n >= need:
                break
            need -= n
        if (least, most) == (low, high):
            break  # neighbours of one cell cannot be told apart further
        low, high = least, most
    ties = keyed.where(F.col("key").between(low, high))
    order = Window.orderBy(F.desc("key"), doc_id)
    ties = ties.withColumn("selected", F.row_number().over(order) <= need)
    rest = keyed.where(~F.col("key").between(low, high)).withColumn("selected", F.col("key") > high)
    return rest.unionByName(ties)


def resample(
    docs: DataFrame, labels: DataFrame, share: float = 0.5, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """One row per document: id, ``log_weight``, ``n_grams``, ``key``, ``selected`` (a ``share`` of all rows).

    The target model is fitted on all documents labelled 1, the raw model on all documents.
    Null and empty texts have weight 0 and take part in the draw; so does everything if nothing is
    labelled 1. A row without id is drawn like the others. An empty table stays empty.
    """
    rows = docs.count()
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(doc_id).distinct()
    told, joined = good_texts(docs, good, rows, doc_id, text)
    target = ngram_counts(told.unionByName(joined), text)
    ratio = log_ratio(target, ngram_counts(docs, text))
    scored = weights(docs.select(doc_id, text), ratio, text, [doc_id])
    return gumbel_top(scored, round(share * rows), doc_id)
