"""Exact top-k by integer inner product, over an impact-ordered index, score at a time.

Every dimension is a posting list of (row, impact), ordered by impact and cut
into segments of ``SEGMENT`` postings.  For a query, a segment's gain is its
largest weighted impact above the dimension's least one, so no gain is
negative.  Segments are processed by falling quantised gain; accumulators are lower
bounds, and each dimension's next segment bounds what a row may still gain.
Processing stops only when all rows but a few are proven to be below the
k-th best accumulator; those few are rescored exactly.

Rows and queries are dealt into blocks, and one task meets one block with one
block.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import keep
from pricetide.llm.vectors import usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
SEGMENT_LEVELS = 16
BLOCK = 16_384
QUERY_BLOCK = 256
#: Segments between two looks at whether processing may stop.
BETWEEN_LOOKS = 64
#: Share of a block's rows that is rescored rather than accumulated further.
RESCORED = 0.05
#: What the products of all dimensions together stay below: bounds take twice as much, and a long holds eight times it.
LARGEST = 2.0**60


class Index:
    """The posting lists of one block of rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(-x, axis=0, kind="stable").T.copy()  # per dimension, rows by falling impact
        self.impact = np.take_along_axis(x.T, self.order, axis=1)
        edges = np.linspace(0, len(x), min(SEGMENT_LEVELS, len(x)) + 1).astype(np.int64)
        self.cuts = np.stack([edges[:-1], edges[1:]], axis=1)
        # segments of one length, so that many are taken at once: the shorter ones end with row ``len(x)``, which is none
        place = self.cuts[:, :1] + np.arange(np.diff(edges).max(initial=0))
        inside = place < self.cuts[:, 1:]
        place = np.where(inside, place, 0)
        self.rows = np.where(inside, self.order[:, place], len(x)).reshape(-1, place.shape[1])
        self.impacts = self.impact[:, place].reshape(-1, place.shape[1])
        self.room = np.empty((2, BETWEEN_LOOKS, place.shape[1]), np.int64)

    def best(self, w: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows among which the ``k`` best are for certain, ties included; ``own`` marks rows that do not count."""
        n, dims = self.x.shape
        if n <= k:
            return np.flatnonzero(~own)
        rising = w < 0  # such a dimension gains most from its smallest impacts: its list is read backwards
        least = np.where(rising, w * self.impact[:, 0], w * self.impact[:, -1])
        first = np.where(rising[:, None], self.impact[:, self.cuts[::-1, 1] - 1], self.impact[:, self.cuts[:, 0]])
        gain = w[:, None] * first - least[:, None]  # (dims, levels), falling along each row
        levels = gain.shape[1]
        quantum = max(1, int(gain.max()) >> 8)
        # a level of a dimension never comes before its earlier ones
        turn = np.lexsort((np.tile(np.arange(levels), dims), -(gain // quantum).ravel()))
        after = np.concatenate([gain[:, 1:], np.zeros((dims, 1), gain.dtype)], axis=1)
        may = gain[:, 0].copy()
        dim, level = np.divmod(turn, levels)
        segment = dim * levels + np.where(rising[dim], levels - 1 - level, level)
        weight, under = w[dim, None], least[dim, None]
        total = np.zeros(n + 1, np.int64)
        for start in range(0, len(turn), BETWEEN_LOOKS):
            now = slice(start, start + BETWEEN_LOOKS)
            rows, gained = self.room[:, : len(segment[now])]
            self.rows.take(segment[now], axis=0, out=rows, mode="clip")
            self.impacts.take(segment[now], axis=0, out=gained, mode="clip")
            gained *= weight[now]
            gained -= under[now]
            np.add.at(total, rows.ravel(), gained.ravel())
            np.minimum.at(may, dim[now], after[dim[now], level[now]])
            reached = total[:n]
            if reached.max() - may.sum() > reached.mean():  # else too many rows may still be among the best
                counted = np.where(own, -1, reached)
                possible = counted + may.sum() >= np.partition(counted, -k)[-k]
                if possible.sum() <= max(k, RESCORED * n):
                    return np.flatnonzero(possible & ~own)
        total = total[:n]
        counted = np.where(own, -1, total)
        return np.flatnonzero((counted >= np.partition(counted, -k)[-k]) & ~own)


def _top(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.combine_chunks().sort_by("vec_id").combine_chunks()
            ids = rows.column("vec_id").to_numpy()
            index = Index(rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
            asked = queries.column("vec_id").to_pylist()
            weights = queries.column("v").combine_chunks().flatten().to_numpy().reshape(len(asked), -1)
            for query, w in zip(asked, weights, strict=True):
                at = index.best(w, k, ids == query)
                score = index.x[at] @ w
                best = np.lexsort((ids[at], -score))[:k]
                found += [(query, int(ids[at[b]]), int(score[b])) for b in best]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of each row for which ``asked`` holds.

    Components become floor(``scale`` * x) and the score is their integer inner product;
    ties go to the smaller id.  Candidates are all rows with another id; with
    fewer than ``k`` all are returned.  Vectors that are null, empty, of another
    length than most, or hold a null or non-finite component take no part; nor do
    those with a component so large that a score, or a bound of one, might not fit a long
    (``LARGEST``).  A zero vector does.  Rows that share an id are candidates each, and ask once,
    by the smallest vector.
    """
    fits = F.forall("v", lambda x: F.abs(x * scale) <= F.sqrt(F.lit(LARGEST) / F.size("v")))
    whole = usable(vectors).where(fits).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    rows = keep(whole)
    asks = rows.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    row_blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    rb, qb = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks))
    dealt = rows.withColumn("rb", rb).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    dealt_asks = asks.withColumn("qb", qb).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    met = dealt.groupBy("rb", "qb").cogroup(dealt_asks.groupBy("rb", "qb")).applyInArrow(_top(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
