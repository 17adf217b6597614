"""Approximate nearest neighbours by largest inner product, over learned partitions.

Rows and queries play different parts, since a long row is near to many queries
and a query's length does not matter.  With M the largest length of a row, rows
are lengthened to (x, sqrt(M^2 - |x|^2)), all of length M, and queries to (x, 0): inner
products stay the same, and among rows they now fall with distance.

On a bounded sample, the graph of nearest lengthened rows is cut into balanced
parts by repeated spectral bisection, and a small network learns in which parts
a row's neighbours lie.  Every row is then indexed under its most probable
part.  A second network learns in which parts a query's nearest rows are
indexed.  A query goes to its most probable parts until they hold ``PROBE_MASS`` of its
probability, and what is there is reranked exactly.

Parts are of uneven size wherever data are, so each is split into blocks of
rows and its queries into blocks of queries; one task meets one block with one
block, whatever the size of a part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import keep
from pricetide.llm.vectors import usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 6_000
PARTS = 16
ROWS_PER_PART = 200
NEIGHBOURS = 12
HIDDEN = 64
EPOCHS = 30
PROBE_MASS = 0.97
BLOCK = 8_192
QUERY_BLOCK = 1_024


def lengths(x: np.ndarray) -> np.ndarray:
    """The length of each row, as a column; components that are huge or tiny do not overflow or vanish when squared."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(np.float64).tiny)
    with np.errstate(over="ignore"):
        return np.minimum(top * np.sqrt(np.square(x / top).sum(axis=1, keepdims=True)), np.finfo(np.float64).max)


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    """Rows of length 1 whose inner products with ``(query, 0)`` are in the proportion of the original ones."""
    x = x / most
    return np.hstack([x, np.sqrt(np.clip(1 - np.square(x).sum(axis=1, keepdims=True), 0, None))])


def features(x: np.ndarray, most: float | None = None) -> np.ndarray:
    """What a network sees: a direction and, of a row, how much shorter than the longest one it is."""
    size = lengths(x)
    short = np.zeros_like(size) if most is None else np.log(size) - np.log(most)
    return np.hstack([x / size, short])


def neighbours(x: np.ndarray, count: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Indexes of the ``count`` rows of largest inner product with each of ``asked``, or of ``x`` itself, without the row of the same place."""
    asked = x if asked is None else asked
    out = np.empty((len(x), min(count, len(x) - 1)), np.int64)
    for start in range(0, len(x), 1024):
        near = asked[start : start + 1024] @ x.T
        near[np.arange(len(near)), start + np.arange(len(near))] = -np.inf
        out[start : start + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def bisected(graph: np.ndarray, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Halves of equal size that cut few edges: sorted by the second eigenvector of the random walk, then refined by swaps."""
    place = np.full(len(graph), -1)
    place[rows] = np.arange(len(rows))
    u = np.repeat(np.arange(len(rows)), graph.shape[1])
    v = place[graph[rows]].ravel()
    u, v = u[v >= 0], v[v >= 0]
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    degree = np.bincount(u, minlength=len(rows)) + 1e-9
    value = draw.normal(size=len(rows))
    for _ in range(60):
        value = 0.5 * value + 0.5 * np.bincount(u, value[v], minlength=len(rows)) / degree
        value -= (value * degree).sum() / degree.sum()
        value /= np.abs(value).max() + 1e-300
    side = np.zeros(len(rows), bool)
    side[np.argsort(value, kind="stable")[len(rows) // 2 :]] = True
    for _ in range(8):  # swap as many on either side as both gain by
        pull = np.bincount(u, np.where(side[v], 1.0, -1.0), minlength=len(rows))
        left = np.flatnonzero(~side & (pull > 0))
        right = np.flatnonzero(side & (pull < 0))
        left, right = left[np.argsort(-pull[left], kind="stable")], right[np.argsort(pull[right], kind="stable")]
        n = min(len(left), len(right)) // 2
        if not n:
            break
        side[left[:n]], side[right[:n]] = True, False
    return rows[~side], rows[side]


def partitioned(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part per row; ``parts`` is a power of two."""
    draw, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for rows in groups for half in bisected(graph, rows, draw)]
    part = np.empty(len(graph), np.int64)
    for i, rows in enumerate(groups):
        part[rows] = i
    return part


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(x: np.ndarray, net: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = net
    return softmax(np.maximum(x @ w1 + b1, 0) @ w2 + b2)


def train(x: np.ndarray, target: np.ndarray, seed: int = 4) -> list[np.ndarray]:
    """A two-layer network whose output approaches the target distributions (Adam on cross-entropy)."""
    draw = np.random.default_rng(seed)
    net = [
        draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, target.shape[1])), np.zeros(target.shape[1]),
    ]
    first, second, step = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(len(x)), max(1, len(x) // 128)):
            step += 1
            w1, b1, w2, b2 = net
            h = np.maximum(x[rows] @ w1 + b1, 0)
            error = (softmax(h @ w2 + b2) - target[rows]) / len(rows)
            back = (error @ w2.T) * (h > 0)
            grads = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ error + 1e-4 * w2, error.sum(axis=0)]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net[i] = net[i] - 0.002 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def shares(parts: np.ndarray, count: int) -> np.ndarray:
    """Per row of ``parts``, the share of each part."""
    out = np.zeros((len(parts), count))
    np.add.at(out, (np.repeat(np.arange(len(parts)), parts.shape[1]), parts.ravel()), 1.0 / parts.shape[1])
    return out


def fit(rows: DataFrame) -> dict:
    """The networks of rows and queries and the largest length, the networks from about ``SAMPLE`` rows of ``(vec_id, v)`` drawn by a hash of the id."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).collect()
    drawn.sort(key=lambda r: (r["vec_id"], r["v"]))
    x = np.array([r["v"] for r in drawn])
    x = x if len(x) else np.zeros((0, 1))
    most = rows.agg(F.max(_length("v"))).first()[0] or 1.0
    parts = 1
    while parts < PARTS and len(x) >= 2 * parts * ROWS_PER_PART:
        parts *= 2
    if parts == 1:
        net = [np.zeros((x.shape[1] + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
        return {"most": most, "rows": net, "queries": net}
    held = lengthened(x, most)
    graph = neighbours(held, NEIGHBOURS)
    of_rows = train(features(x, most), shares(partitioned(graph, parts)[graph], parts))
    part = probabilities(features(x, most), of_rows).argmax(axis=1)
    wanted = neighbours(held, NEIGHBOURS, np.hstack([x / lengths(x), np.zeros((len(x), 1))]))
    return {"most": most, "rows": of_rows, "queries": train(features(x), shares(part[wanted], parts))}


def _length(column: str) -> Column:
    """The length of a vector, at most the largest double."""
    top = F.array_max(F.transform(column, F.abs))
    total = F.aggregate(F.transform(column, lambda x: (x / top) * (x / top)), F.lit(0.0), lambda a, b: a + b)
    return F.least(top * F.sqrt(total), F.lit(float(np.finfo(np.float64).max)))


def _routed(shared, mass: float, held: list[int] | None, least: int):
    """``(vec_id, v, parts)``: a row's most probable part, or with ``held`` (rows per part) as many as a query asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            model = shared.value
            p = probabilities(features(x, model["most"]), model["rows"]) if held is None else probabilities(features(x), model["queries"])
            order = np.argsort(-p, axis=1, kind="stable")
            if held is None:
                wanted = np.ones(len(x), np.int64)
            else:
                before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
                rows = np.cumsum(np.array(held)[order], axis=1) - np.array(held)[order]
                wanted = ((before < mass) | (rows < least)).sum(axis=1)
            chosen = order[np.arange(order.shape[1]) < wanted[:, None]]
            ends = pa.array(np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32))
            parts = pa.ListArray.from_arrays(ends, pa.array(chosen.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], names=["vec_id", "v", "parts"])

    return run


def _nearest(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.combine_chunks().sort_by("vec_id").combine_chunks()
            ids = rows.column("vec_id").to_numpy()
            x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            asked = queries.column("vec_id").to_pylist()
            q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(len(asked), -1)
            for start in range(0, len(asked), 128):
                near = q[start : start + 128] @ x.T
                for i, scores in enumerate(near):
                    scores[ids == asked[start + i]] = -np.inf
                    bound = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
                    # the product's last bits depend on where a row stands; near the bound all rows are summed alike
                    at = np.flatnonzero((scores >= bound - 1e-9 * max(1.0, abs(bound))) & (scores > -np.inf)) if bound > -np.inf else np.flatnonzero(scores > -np.inf)
                    exact = np.zeros(len(at))
                    for d in range(x.shape[1]):
                        exact += q[start + i, d] * x[at, d]
                    best = np.lexsort((ids[at], -exact))[:k]
                    found += [(asked[start + i], int(ids[at[b]]), float(exact[b])) for b in best]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, types, strict=True)})

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = 20, mass: float = PROBE_MASS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row for which ``asked`` holds.

    ``vectors(vec_id, embedding)``; a condition on ``vec_id`` says which rows ask.  Candidates
    are all rows with another id.  The score is the inner product in double
    precision, summed from the first component on; ties go to the smaller id.
    Vectors that are null, empty, zero, of another length than most, or hold a
    null or non-finite component take no part.  Rows that share an id are
    candidates each, and ask once, by the smallest vector.  With fewer than ``k`` candidates all are returned: a query goes on to
    further parts until those hold more than ``k`` rows.
    """
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    model = fit(rows)
    parts = len(model["rows"][3])
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "vec_id long, v array<double>, parts array<int>"
    placed = keep(rows.mapInArrow(_routed(shared, mass, None, 0), schema).select("vec_id", "v", F.col("parts")[0].alias("part")))
    held = [0] * parts
    for r in placed.groupBy("part").count().collect():  # at most PARTS rows
        held[r["part"]] = r["count"]
    asking = rows.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    asks = keep(asking.mapInArrow(_routed(shared, mass, held, k + 1), schema).withColumn("part", F.explode("parts")).drop("parts"))
    arriving = [0] * parts
    for r in asks.groupBy("part").count().collect():
        arriving[r["part"]] = r["count"]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("part") + 1)

    row_blocks = of([max(1, -(-n // BLOCK)) for n in held])
    query_blocks = of([max(1, -(-n // QUERY_BLOCK)) for n in arriving])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    dealt = placed.withColumn("rb", F.pmod(F.xxhash64("vec_id"), row_blocks)).withColumn("qb", every(query_blocks))
    dealt_asks = asks.withColumn("qb", F.pmod(F.xxhash64("vec_id"), query_blocks)).withColumn("rb", every(row_blocks))
    key = ["part", "rb", "qb"]
    met = dealt.groupBy(*key).cogroup(dealt_asks.groupBy(*key)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
