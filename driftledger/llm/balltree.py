"""Exact top-k inner products by ball trees, branch and bound.

Vectors are dealt to clusters around a bounded sample of centres, and large clusters are cut into
shards, each with a ball tree of its own. A query visits a shard only if the cluster's ball can hold a
score as high as its current k-th one, and inside a shard nodes in order of their upper bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import hashed_sample, stored

#: Clusters (bounded, their centres are shared), rows per shard, queries per block, vectors per leaf.
CENTRES, SHARD, QUERIES, LEAF = 64, 4096, 1024, 64
_SLACK = 1e-7


@dataclass
class Ball:
    low: int
    high: int
    centre: np.ndarray
    radius: float
    left: Ball | None = None
    right: Ball | None = None


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Ball, np.ndarray]:
    """A ball tree, and the order of the rows in which its nodes are ranges."""
    order = np.arange(len(vectors))

    def grow(low: int, high: int) -> Ball:
        own = vectors[order[low:high]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        ball = Ball(low, high, centre, float(away.max()))
        if high - low > leaf and ball.radius > 0:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            half = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(side, half)]
            ball.left, ball.right = grow(low, low + half), grow(low + half, high)
        return ball

    return grow(0, len(vectors)), order


class Search:
    """Best ``k`` of one shard for a block of queries, which all share the bounds they have so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.root, order = build(vectors)
        self.ids, self.vectors, self.k = ids[order], vectors[order], k

    def run(self, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (k columns, padded with -inf): all that is not below ``floor`` is found."""
        self.qids, self.queries = qids, queries
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.least = floor.astype(np.float64).copy()
        self.scores = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)), self._bound(self.root, np.arange(len(queries))))
        return self.scores, self.found

    def _bound(self, ball: Ball, rows: np.ndarray) -> np.ndarray:
        bound = self.queries[rows] @ ball.centre + self.norms[rows] * ball.radius
        return bound + _SLACK * (1 + np.abs(bound))

    def _visit(self, ball: Ball, rows: np.ndarray, bound: np.ndarray) -> None:
        rows = rows[bound >= self.least[rows]]
        if not len(rows):
            return
        if ball.left is None:
            self._leaf(ball, rows)
            return
        left, right = self._bound(ball.left, rows), self._bound(ball.right, rows)
        # each query goes to the side with the higher bound first
        for first, a, b, bound_a, bound_b in (
            (left >= right, ball.left, ball.right, left, right), (left < right, ball.right, ball.left, right, left)
        ):
            if first.any():
                self._visit(a, rows[first], bound_a[first])
                self._visit(b, rows[first], bound_b[first])

    def _leaf(self, ball: Ball, rows: np.ndarray) -> None:
        ids = self.ids[ball.low : ball.high]
        scores = self.queries[rows] @ self.vectors[ball.low : ball.high].T
        scores[self.qids[rows][:, None] == ids] = -np.inf  # a query is not its own answer
        every = np.hstack([self.scores[rows], scores])
        names = np.hstack([self.found[rows], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(every, order, axis=1)
        self.found[rows] = np.take_along_axis(names, order, axis=1)
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])


def whole_vectors(df: DataFrame, queries: str, vec_id: str, vector: str) -> DataFrame:
    """``id``, ``v`` and ``q``: components times 256, rounded down, of usable vectors; whether they ask.

    Null vectors, empty ones and those with a null or non-finite component take no part.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    usable = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good
    return df.where(F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), scaled.alias("v"), F.coalesce(F.expr(queries), F.lit(False)).alias("q")
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top_k(
    df: DataFrame, queries: str, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    centres: int = CENTRES, shard: int = SHARD, block: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``k`` best other vectors.

    ``queries`` is a condition on the table. The score is the exact inner product of the components
    times 256, rounded down; ties go to the smaller id. A vector is compared with those of its length
    only. Rows with one id never answer each other; a repeated id is a candidate as often as it comes and
    asks once, with the least of its vectors. With fewer than ``k`` candidates all are returned; no usable vector gives no row.

    Scores are exact while they stay below 2**53. A cell of work is one shard with one block of
    queries, so no task grows with the table or with a hot cluster.
    """
    spark = df.sparkSession
    rows = stored(whole_vectors(df, queries, vec_id, vector), "vectors")
    sample = [np.array(r.v) for r in hashed_sample(rows, "id", centres).orderBy(F.xxhash64("id")).limit(centres).collect()]
    # shared: at most CENTRES vectors
    shared = spark.sparkContext.broadcast(sample)

    def nearest(batches):
        middle: dict[int, list[int]] = {}
        for i, v in enumerate(shared.value):
            middle.setdefault(len(v), []).append(i)
        for pdf in batches:
            cluster, away = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            size = pdf["v"].map(len).to_numpy()
            for d in np.unique(size):
                at, own = np.flatnonzero(size == d), middle.get(int(d))
                v = _stack(pdf["v"].iloc[at])
                if own is None:  # no centre of this length: a cluster of its own, around zero
                    cluster[at], away[at] = -d, np.sqrt((v**2).sum(axis=1))
                    continue
                c = np.stack([shared.value[i] for i in own])
                gap = (v**2).sum(axis=1)[:, None] - 2 * v @ c.T + (c**2).sum(axis=1)
                best = gap.argmin(axis=1)
                cluster[at] = np.array(own)[best]
                away[at] = np.sqrt(((v - c[best]) ** 2).sum(axis=1))
            yield pdf.assign(cluster=cluster, away=away)

    dealt = stored(rows.mapInPandas(nearest, "id long, v array<double>, q boolean, cluster long, away double"), "dealt")
    balls = dealt.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    # one row per cluster: CENTRES and the lengths that occur
    known = {r.cluster: (r.radius, max(1, -(-r.n // shard))) for r in balls.collect()}
    pieces = F.create_map(*(F.lit(x) for c, (_, n) in known.items() for x in (c, n))) if known else F.lit(None)
    piece = F.pmod(F.xxhash64("id"), pieces[F.col("cluster")]) if known else F.lit(0).cast("long")
    candidates = dealt.select("id", "v", "cluster", piece.alias("piece"))
    asked = dealt.where("q").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)))
    balls_known = spark.sparkContext.broadcast(known)

    def visits(first: bool):
        """The shard with the best bound, or every further one that can reach the floor."""

        def run(batches):
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    v = np.asarray(row.v, np.float64)
                    norm = np.sqrt((v**2).sum())
                    bounds = {}
                    for c, (radius, n) in balls_known.value.items():
                        centre = shared.value[c] if c >= 0 else np.zeros(-c)
                        if len(centre) == len(v):
                            bound = float(v @ centre + norm * radius)
                            bounds[c] = bound + _SLACK * (1 + abs(bound))
                    if not bounds:
                        continue
                    best = max(bounds, key=lambda c: (bounds[c], -c))
                    for c, bound in bounds.items():
                        for p in range(balls_known.value[c][1]):
                            if first == (c == best and p == 0) and bound >= row.floor:
                                out.append((row.id, row.v, row.block, row.floor, c, p))
                yield pd.DataFrame(out, columns=["id", "v", "block", "floor", "cluster", "piece"])

        return run

    cell = ["cluster", "piece", "block"]
    laid = candidates.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = Search(left["id"].to_numpy(), _stack(left["v"]), k)
            scores, found = tree.run(right["id"].to_numpy(), _stack(right["v"]), right["floor"].to_numpy())
            for q, s, f in zip(right["id"], scores, found):
                out.extend((q, i, int(x)) for x, i in zip(s, f) if x > -np.inf)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def answered(asked: DataFrame, first: bool) -> DataFrame:
        schema = "id long, v array<double>, block long, floor double, cluster long, piece long"
        to = asked.mapInPandas(visits(first), schema)
        found = laid.groupBy(*cell).cogroup(to.groupBy(*cell))
        return found.applyInPandas(search, "query_id long, vec_id long, score long")

    start = stored(answered(asked.withColumn("floor", F.lit(float("-inf"))), True), "first-answers")
    reached = start.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor")
    )
    asked = asked.join(reached, asked.id == reached.query_id, "left").select(
        "id", "v", "block", F.coalesce("floor", F.lit(float("-inf"))).cast(DoubleType()).alias("floor")
    )
    every = start.unionByName(answered(asked, False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
