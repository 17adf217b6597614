"""Nearest neighbours and exact top-k against comparing everything."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import ann, queries, topk
from pricetide.llm.common import table

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, part string, v string"
ODD = [
    (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, []), (5, [1.0, None]), (6, [math.nan, 1.0]),
    (7, [math.inf, 0.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [-1.0, -0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, modulo, k, number, zero):
    good = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q in sorted({i for i, _ in good if i % modulo == 0}):
        w = min(v for i, v in good if i == q)
        scored = sorted((-sum(number(a) * number(b) for a, b in zip(v, w, strict=True)), i) for i, v in good if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], start=1)]
    return out


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_nearest_of_few_odd_rows_is_complete(spark):
    got = collected(ann.nearest(frame(spark, ODD), F.col("vec_id") % 20 == 0, 4))
    assert got == brute(ODD, 20, 4, float, False)
    assert collected(ann.nearest(frame(spark, ODD), F.col("vec_id") % 20 == 0, 50)) == brute(ODD, 20, 50, float, False)


def test_top_k_of_odd_rows(spark):
    floor = lambda x: math.floor(256 * x)
    for k in (3, 50):
        assert collected(topk.top_k(frame(spark, ODD), F.col("vec_id") % 20 == 0, k)) == brute(ODD, 20, k, floor, True)


def test_empty_tables(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(frame(spark, [(3, None)]), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
def test_recall(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.op3_nearest_neighbours(spark, FOLDER).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        near = x @ x[i]
        near[i] = -np.inf
        best = np.lexsort((ids, -near))[:20]
        found = sorted(got.pop(int(ids[i])), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and len({r["vec_id"] for r in found}) == 20
        assert all(abs(r["score"] - x[i] @ x[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in found)
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(found, found[1:], strict=False))
        hits.append(len(set(ids[best]) & {r["vec_id"] for r in found}) / 20)
    assert not got and np.mean(hits) >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(8, 16)) * 4
    x = (centers[np.arange(1600) % 8] + draw.normal(size=(1600, 16))).astype(float)
    graph = ann.neighbours(x / np.linalg.norm(x, axis=1, keepdims=True), 10)
    part = ann.partitioned(graph, 8)
    assert np.bincount(part).tolist() == [200] * 8
    assert (part[graph] == part[:, None]).mean() > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_index_proves_what_it_leaves_out(seed):
    draw = np.random.default_rng(seed)
    x = draw.integers(-40, 41, (3000, 24))
    if seed % 2:
        x[draw.integers(0, 3000, 900)] = x[0]
    index = topk.Index(x)
    for w in (x[5], draw.integers(-200, 201, 24), np.zeros(24, int)):
        own = np.arange(3000) == 5
        at = index.best(w, 5, own)
        score = x @ w
        want = np.lexsort((np.arange(3000), -np.where(own, -(10**9), score)))[:5]
        best = at[np.lexsort((at, -score[at]))[:5]]
        assert best.tolist() == want.tolist()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=2).astype(np.float32).tolist()) for i in range(700)]
    floor = lambda x: math.floor(256 * x)
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    assert collected(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 5)) == brute(rows, 20, 5, floor, True)


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_by_inner_product(spark, monkeypatch, sigma):
    """Lengths that differ by log-normal factors; nine rows in ten are outside the sample."""
    monkeypatch.setattr(ann, "SAMPLE", 1_600)
    draw = np.random.default_rng(7)
    centers = draw.normal(size=(30, 32))
    x = centers[draw.integers(0, 30, 16_000)] + draw.normal(size=(16_000, 32))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(sigma * draw.normal(size=(16_000, 1)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in range(0, len(x), 20):
        near = x @ x[i]
        near[i] = -np.inf
        hits.append(len(set(np.argsort(-near)[:20].tolist()) & got[i]) / 20)
    print("recall", sigma, np.mean(hits))
    assert np.mean(hits) >= 0.9


def test_huge_and_tiny_components_are_searched(spark):
    rows = [(20, [1e150, 0.0]), (1, [1e-300, 0.0]), (2, [2e-300, 1e-320]), (3, [-1e150, 1.0]), (40, [1e-310, 0.0]), (5, [1e300, 1e300])]
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 4))
    assert [(q, n, i) for q, n, i, _ in got if q == 20] == [(20, 1, 5), (20, 2, 2), (20, 3, 1), (20, 4, 40)]
    assert len([r for r in got if r[0] == 40]) == 4


def test_components_that_no_long_can_score_take_no_part(spark):
    big = 2.0**60 / 512  # squared and scaled far beyond a long
    edge = math.sqrt(2.0**60 / 2) / 256
    rows = [(20, [1.0, 0.0]), (1, [big, 0.0]), (2, [1e300, 1.0]), (3, [0.5, 0.5]), (4, [edge * 0.999, -edge * 0.999]), (40, [edge * 0.999, edge * 0.999]), (5, [-edge * 0.999, edge * 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    floor = lambda x: math.floor(256 * x)
    kept = [r for r in rows if r[0] not in (1, 2)]
    assert collected(topk.top_k(df, F.col("vec_id") % 20 == 0, 3)) == brute(kept, 20, 3, floor, True)


@pytest.mark.parametrize("n", [6, 17, 1000, 1003])
def test_segments_are_taken_many_at_once(n):
    """Segments of unequal lengths are filled up with a row that is none."""
    draw = np.random.default_rng(n)
    x = draw.integers(-40, 41, (n, 9))
    index = topk.Index(x)
    levels = min(topk.SEGMENT_LEVELS, n)
    assert index.rows.shape == index.impacts.shape == (9 * levels, -(-n // levels))
    assert sorted(index.rows[index.rows < n].tolist()) == sorted(list(range(n)) * 9)
    for w in (x[2], draw.integers(-200, 201, 9)):
        own = np.arange(n) == 2
        at, score = index.best(w, 3, own), x @ w
        want = np.lexsort((np.arange(n), -np.where(own, -(10**9), score)))[:3]
        assert at[np.lexsort((at, -score[at]))[:3]].tolist() == want.tolist()
