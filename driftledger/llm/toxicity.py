"""Toxicity by nearest labelled examples.

Whole texts are TF-IDF vectors. The nearest labelled examples by exact cosine are found in an inverted index
with block maxima: examples lie in blocks of alike ones, a text's heaviest terms are looked up first, and of
the frequent terms only the blocks are read whose maxima leave room for a score among the best. The examples'
votes, weighted by distance and by how far the terms they share with the text tell the labels apart, give a
calibrated score and the evidence for it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .balltree import build
from .common import add_columns, bound_batches, hashed_sample, stored

#: Bounds of the model: labelled rows it is fitted on, and bytes of them, about.
TRAIN_ROWS, TRAIN_BYTES = 4096, 64 << 20
#: A shared term votes by ``BASE`` and by what its log odds ratio exceeds ``SURE`` standard errors by.
BASE, SURE = 0.01, 3.0
#: Examples that vote, and those named as evidence; terms read by blocks (the most frequent ones); examples per
#: block; texts looked up together.
NEIGHBOURS, EVIDENCE, FREQUENT, BLOCK, BATCH = 100, 10, 512, 64, 128
#: Least votes of either side, and how much the calibration is held to small values.
_LEAST, _RIDGE = 0.01, 1e-3
_TERM = re.compile(r"[^\W\d_]+")
#: Scripts that are written without spaces between words: their terms are pairs of letters.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
#: A longer letter run is known by its digest, so that no term is large.
_LONGEST = 100


def terms(text: str | None) -> list[str]:
    if not text:
        return []
    found = _TERM.findall(text.lower())
    if not text.isascii() and _UNSPACED.search(text):
        pairs = [[t[i : i + 2] for i in range(max(1, len(t) - 1))] if _UNSPACED.search(t) else [t] for t in found]
        found = [x for p in pairs for x in p]
    if len(text) > _LONGEST:
        return [t if len(t) <= _LONGEST else hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in found]
    return found


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's terms, and how often each occurs."""
    counts = Counter(terms(text))
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t) for t in counts], np.uint64), np.array([*counts.values()], np.float64)


def strength(n0: np.ndarray, n1: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """What terms in ``n0`` of ``y0`` clean and ``n1`` of ``y1`` toxic examples say about the label.

    Rests on the odds ratio, which does not depend on how many examples are toxic.
    """
    a, b, c, d = n1 + 0.5, y1 - n1 + 0.5, n0 + 0.5, y0 - n0 + 0.5
    apart = np.abs(np.log(a * d / (b * c))) - SURE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.maximum(apart, 0)


@dataclass
class Index:
    """Postings of every term, and of the most frequent ones a dense row with the maxima of its blocks.

    ``seats`` number the examples in the order of the blocks. Only postings are sent to executors, which make
    the dense rows of them.
    """

    vocabulary: np.ndarray  # sorted hashes of the examples' terms
    idf: np.ndarray
    strong: np.ndarray  # strength of a term
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    empty: float
    starts: np.ndarray  # where a term's postings begin
    seats: np.ndarray
    weights: np.ndarray
    slope: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        self.dense, self.skipped, self.read = None, 0, 0

    def __getstate__(self):
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"dense": None, "skipped": 0, "read": 0}

    @classmethod
    def of(cls, vocabulary, frequency, total, ids, labels, sizes, term, often) -> Index:
        """From flat arrays: ``sizes`` terms of each example after each other in ``term`` and ``often``."""
        y = np.array(labels, np.float64)
        sizes, width = np.asarray(sizes, np.int64), len(vocabulary)
        bare = sizes == 0
        prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
        # without evidence a text is clean, unless the examples without terms are mostly toxic
        empty = float(y[bare].sum() / (bare.sum() + 2))
        idf = np.log((1 + total) / (1 + np.asarray(frequency, np.float64))) + 1
        example = np.repeat(np.arange(len(sizes)), sizes)
        weight = (1 + np.log(np.asarray(often, np.float64))) * idf[term]
        weight /= np.sqrt(np.bincount(example, weight * weight, minlength=len(sizes)))[example]
        # examples with terms, by id at first, then in an order that has alike ones together
        named = np.array(sorted(np.flatnonzero(~bare).tolist(), key=lambda i: (str(ids[i])[::-1], labels[i])), np.int64)
        held = np.bincount(term, minlength=width)
        top = np.full(width, -1)
        top[np.argsort(-held, kind="stable")[:FREQUENT]] = np.arange(min(FREQUENT, width))
        rough = np.zeros((len(sizes), min(FREQUENT, width)))
        often_held = top[term] >= 0
        rough[example[often_held], top[term[often_held]]] = weight[often_held]
        order = named[build(rough[named], BLOCK)[1]] if len(named) else named
        seat = np.full(len(sizes), -1, np.int64)
        seat[order] = np.arange(len(order))
        toxic = y[example] > 0
        n1 = np.bincount(term[toxic], minlength=width)
        by_term = np.lexsort((seat[example], term))
        return cls(
            np.asarray(vocabulary, np.uint64), idf, strength(held - n1, n1, len(y) - y.sum(), y.sum()),
            np.array([-1 if ids[i] is None else ids[i] for i in order], np.int64),
            np.array([labels[i] for i in order], np.int8), prior, empty,
            np.append(0, np.cumsum(held)).astype(np.int64), seat[example][by_term].astype(np.int32), weight[by_term],
        )

    def fill(self) -> None:
        """``rank`` (per term: its row in ``dense``, or -1), ``dense`` (terms x seats) and its block maxima ``peak``."""
        held = np.diff(self.starts)
        self.rank = np.full(len(held), -1, np.int64)
        top = np.argsort(-held, kind="stable")[:FREQUENT]
        self.rank[top] = np.arange(len(top))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.dense = np.zeros((len(top), self.blocks * BLOCK))
        term = np.repeat(np.arange(len(held)), held)
        often = self.rank[term] >= 0
        self.dense[self.rank[term[often]], self.seats[often]] = self.weights[often]
        self.peak = self.dense.reshape(len(top), self.blocks, BLOCK).max(axis=2) if len(top) else np.zeros((0, self.blocks))

    def _add(self, row: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> None:
        """Add to ``row`` what the postings of the terms give."""
        begin, end = self.starts[numbers], self.starts[numbers + 1]
        spans = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist())]
        if spans:
            part = np.concatenate([self.weights[x] for x in spans]) * np.repeat(weights, end - begin)
            row += np.bincount(np.concatenate([self.seats[x] for x in spans]), part, len(row))

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ``k`` nearest examples (cosines, seats) of each vector, exactly; ties go to the smaller id."""
        if not len(self.ids) or not vectors:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in vectors]
        if self.dense is None:
            self.fill()
        n, width = len(vectors), self.blocks * BLOCK
        query, scores = np.zeros((n, len(self.dense))), np.zeros((n, width))
        for i, (numbers, weights) in enumerate(vectors):
            rank = self.rank[numbers]
            query[i, rank[rank >= 0]] = weights[rank >= 0]
            # the rarer terms are the heaviest: their postings come first and in full
            self._add(scores[i], numbers[rank < 0], weights[rank < 0])
        bound = scores.reshape(n, self.blocks, BLOCK).max(axis=2) + query @ self.peak + 1e-9
        first = min(self.blocks, -(-k // BLOCK) + 1)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        seen = np.zeros((n, self.blocks), bool)
        np.put_along_axis(seen, best, True, axis=1)
        self._read(seen, query, scores)
        known = np.where(np.repeat(seen, BLOCK, axis=1), scores, -1.0)[:, : len(self.ids)]
        least = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] > k else np.full(n, -1.0)
        more = (bound >= least[:, None]) & ~seen
        self._read(more, query, scores)
        seen |= more
        self.read, self.skipped = self.read + int(seen.sum()), self.skipped + int((~seen).sum())
        scores = np.where(np.repeat(seen, BLOCK, axis=1), scores, -1.0)[:, : len(self.ids)]
        out = []
        for row in scores:
            if len(row) > k:
                # all that can be among the first k after rounding
                some = np.flatnonzero((row >= np.partition(row, -k)[-k] - 1e-11) & (row > 0))
            else:
                some = np.flatnonzero(row > 0)
            own = np.round(row[some], 12)
            order = np.lexsort((self.ids[some], -own))[:k]
            out.append((own[order], some[order]))
        return out

    def _read(self, wanted: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        """Add the frequent terms' part to the blocks each query wants."""
        for block in np.flatnonzero(wanted.any(axis=0)).tolist():
            rows = np.flatnonzero(wanted[:, block])
            own = slice(block * BLOCK, (block + 1) * BLOCK)
            scores[rows, own] += query[rows] @ self.dense[:, own]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a whole text's terms, of unit length; terms of no example are not in the space."""
        names, counts = hashed(text)
        if not len(self.vocabulary) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, names), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == names
        numbers = at[known]
        order = np.argsort(numbers)
        numbers = numbers[order]
        weights = (1 + np.log(counts[known][order])) * self.idf[numbers]
        return numbers, weights / (np.sqrt((weights * weights).sum()) or 1.0)

    def votes(self, vector: tuple[np.ndarray, np.ndarray], cosine: np.ndarray, seat: np.ndarray) -> float:
        """Log of the votes for toxic over those for clean."""
        numbers, weights = vector
        tells = self.strong[numbers] > 0
        shared = np.zeros(len(self.ids))
        self._add(shared, numbers[tells], weights[tells] * self.strong[numbers[tells]])
        vote = (BASE * cosine + shared[seat]) / (1.05 - np.minimum(cosine, 1.0))
        toxic = self.labels[seat] > 0
        return float(np.log((vote[toxic].sum() + _LEAST) / (vote[~toxic].sum() + _LEAST)))

    def judge_all(self, texts: list[str | None], k: int, own: list[int | None] | None = None) -> list[tuple]:
        """Score, evidence (example, label, cosine) and vote of whole texts; ``own`` names an example that is left out."""
        out = []
        for low in range(0, len(texts), BATCH):
            part = texts[low : low + BATCH]
            single = list(dict.fromkeys(part))
            vectors = [self.vector(t) for t in single]
            nearest = self.nearest_of(vectors, k + (own is not None))
            known = dict(zip(single, zip(vectors, nearest)))
            for i, text in enumerate(part, low):
                vector, (cosine, seat) = known[text]
                if own is not None:
                    other = self.ids[seat] != own[i]
                    cosine, seat = cosine[other][:k], seat[other][:k]
                if not len(seat):
                    out.append((self.empty, [], None))
                    continue
                vote = self.votes(vector, cosine, seat)
                score = 1 / (1 + math.exp(-min(max(self.slope[0] + self.slope[1] * vote, -30), 30)))
                shown = seat[:EVIDENCE]
                evidence = list(zip(self.ids[shown].tolist(), self.labels[shown].tolist(), cosine[:EVIDENCE].tolist()))
                out.append((score, evidence, vote))
        return out


def calibrated(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Offset and slope that turn votes into probabilities; either label counts one more time than it occurs."""
    n1 = labels.sum()
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    at, columns = np.array([0.0, 1.0]), np.stack([np.ones(len(votes)), votes], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ at, -30, 30)))
        bend = (columns * (p * (1 - p))[:, None]).T @ columns + _RIDGE * np.eye(2)
        step = np.linalg.solve(bend, columns.T @ (goal - p) - _RIDGE * (at - [0, 1]))
        at = at + np.clip(step, -2, 2)
    return float(at[0]), float(at[1])


def document_frequency(docs: DataFrame, vocabulary: Broadcast, width: int) -> tuple[np.ndarray, int]:
    """In how many rows of ``text`` each term of the vocabulary occurs, and the rows; tasks send sums only."""

    def run(batches):
        own, total, rows = vocabulary.value, np.zeros(width + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column("text"):
                names = np.array([xxhash.xxh3_64_intdigest(t) for t in set(terms(text.as_py()))], np.uint64)
                at = np.searchsorted(own, names)
                at[at == width] = 0
                total[at[own[at] == names] if width else at[:0]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], ["number", "n"]
        )

    bound_batches(docs.sparkSession)
    sums = docs.mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    number, n = (sums.column(c).to_numpy() for c in ("number", "n"))
    out = np.zeros(width, np.int64)
    out[number[number >= 0]] = n[number >= 0]
    return out, int(n[number < 0].sum())


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS, k: int = NEIGHBOURS,
) -> Index:
    """Fit on about ``rows`` labelled rows, picked by a hash of their id; equal texts count once.

    Of very long texts fewer are taken, so that the sample holds about ``TRAIN_BYTES``. A row without label or
    id is not learnt from; of several labels of one id the highest holds. The sample's ids are broadcast, and
    the driver gets the hashes of its texts' terms and their counts, no texts. In how many texts a term occurs
    is counted over all of ``docs``. Every example is then judged by the others, and that calibrates the score.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    chosen = chosen.groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("label"))
    typical = docs.agg(F.avg(F.octet_length(F.col(text)))).first()[0] or 0
    rows = max(1, min(rows, int(TRAIN_BYTES / max(typical, 1))))
    chosen = F.broadcast(hashed_sample(chosen, "id", rows))
    known = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(chosen, "id")
    known = stored(known.dropDuplicates(["text"]), "toxicity-sample")

    def counted(texts: pa.Array) -> list[pa.Array]:
        found = [hashed(t) for t in texts.to_pylist()]
        return [
            pa.array([n.view(np.int64) for n, _ in found], pa.list_(pa.int64())),
            pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
        ]

    made = [StructField("names", ArrayType(LongType())), StructField("counts", ArrayType(IntegerType()))]
    found = add_columns(known, ["text"], made, counted, ["id", "label"]).toArrow()
    names, often = (
        np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in found.column(c).chunks)])
        for c, kind in (("names", np.int64), ("counts", np.int32))
    )
    sizes = [n for x in found.column("names").chunks for n in x.value_lengths().to_pylist()]
    ids, marks = found.column("id").to_pylist(), found.column("label").to_pylist()
    del found
    vocabulary, term = np.unique(names.view(np.uint64), return_inverse=True)
    context = docs.sparkSession.sparkContext
    frequency, total = document_frequency(
        docs.select(F.col(text).alias("text")), context.broadcast(vocabulary), len(vocabulary)
    )
    index = Index.of(vocabulary, frequency, total, ids, marks, sizes, term, often)
    shared = context.broadcast(index)

    def judged(own: pa.Array, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([v for *_, v in shared.value.judge_all(texts.to_pylist(), k, own.to_pylist())], pa.float64())]

    voted = add_columns(known, ["id", "text"], [StructField("vote", DoubleType())], judged, ["label"])
    voted = voted.where("vote is not null").orderBy("vote", "label").toArrow()
    index.slope = calibrated(voted.column("vote").to_numpy(), voted.column("label").to_numpy())
    return index


def score(
    docs: DataFrame, index: Index, text: str = "text", k: int = NEIGHBOURS, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``evidence``.

    ``k`` examples vote, and ``evidence`` lists the nearest of them (``EVIDENCE``): id, label, cosine. A text that shares no term with an
    example (also null or empty) scores as the labelled examples without terms do, and has no evidence;
    without any example every text scores 0. Equal texts score alike. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    row = StructType([StructField("id", LongType()), StructField("label", IntegerType()), StructField("cosine", DoubleType())])
    arrow = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = shared.value.judge_all(texts.to_pylist(), k)
        places = np.cumsum([0, *(len(e) for _, e, _ in found)])
        flat = [x for _, e, _ in found for x in e]
        columns = list(zip(*flat)) or [[]] * 3
        kinds = [pa.int64(), pa.int32(), pa.float64()]
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "label", "cosine"])
        return [
            pa.array([s for s, *_ in found], pa.float64()),
            pa.array([int(s >= 0.5) for s, *_ in found], pa.int32()),
            pa.ListArray.from_arrays(pa.array(places, pa.int32()), values).cast(arrow),
        ]

    made = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("evidence", ArrayType(row))]
    return add_columns(docs, [text], made, compute, keep)
