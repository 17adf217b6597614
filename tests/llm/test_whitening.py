"""Whitening against numpy's own eigenvalues and plain sums."""

import math
import random

import numpy as np
import pytest

from pricetide.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, component string, n string"


def brute(rows, components=16):
    """The contract, with numpy's eigenvalues."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable]
    fit = np.array(sorted({x for _, x in grid}), np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for place, (i, x) in enumerate(grid):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(min(components, len(values))):
            e = values[-1 - k]
            w = float((np.array(x, np.float64) - fit.mean(axis=0)) @ vectors[:, -1 - k] / math.sqrt(e))
            out[place, k + 1] = (i, n, deviation, abs(w), e / values.sum())
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    return whitening.whiten(df, whitening.fit(df, **kw)).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_equals_numpy(spark, size):
    draw = random.Random(size)
    rows = [(i, [draw.gauss(0, 1 + 0.2 * d) for d in range(size)]) for i in range(300)]
    rows += rows[:20] + [(900 + i, rows[5][1]) for i in range(100)]  # repeated rows and a frequent vector
    found = run(spark, rows)
    want = brute(rows)
    assert len(found) == len(want) and all(r.identity_error < 1e-9 for r in found)
    pairs = zip(sorted(found, key=lambda r: (r.component, r.vec_id)), sorted((k[1], v) for k, v in want.items()), strict=True)
    for got, (component, (i, n, deviation, white, explained)) in pairs:
        assert (got.vec_id, got.component, got.n, got.deviation) == (i, component, n, deviation)
        assert abs(got.whitened) == pytest.approx(white, abs=1e-7) and got.explained == pytest.approx(explained, rel=1e-9)


def matrices():
    draw = np.random.default_rng(11)
    for n in (1, 2, 3, 5, 20, 64):
        a = draw.standard_normal((n, n))
        yield a @ a.T
        q, _ = np.linalg.qr(a)
        yield (q * np.repeat([5.0, 1.0], [n // 2, n - n // 2])) @ q.T  # two values, each many times
        yield (q * 10.0 ** -np.arange(n).clip(max=12)) @ q.T
        yield np.diag(draw.integers(0, 3, n).astype(float))
    # values that agree in all but the last digits
    yield np.diag(np.r_[np.ones(21), 0]) + np.diag(np.full(21, 1e-14), 1) + np.diag(np.full(21, 1e-14), -1)
    off = np.ones(20)
    yield np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(off, 1) + np.diag(off, -1)  # pairs of nearly equal values
    yield 1e-200 * np.diag([3.0, 2.0, 1.0])


def test_components_of_matrices():
    for a in matrices():
        values, vectors = whitening.leading_components(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        top = np.abs(a).max()
        assert len(values) == (min(16, len(a)) if top else 0)
        assert np.all(np.abs(values - want) <= 1e-13 * len(a) * top) and np.all(np.diff(values) <= 0)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
        assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) <= 1e-13 * len(a) * top


def test_sturm_counts():
    draw = np.random.default_rng(2)
    diagonal, off = draw.standard_normal(12), draw.standard_normal(11)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.concatenate([values - 1e-9, values + 1e-9])
    assert whitening.sturm_counts(diagonal, off * off, at, 1e-300).tolist() == [*range(12), *range(1, 13)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0]), (2, [0.5, -1.0]), (3, [0.25, 0.125]), (None, [0.5, -1.0]), (2, [0.5, -1.0])]
    bad = [(4, None), (5, []), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [1e300, 1.0]), (10, [1.0])]
    found = run(spark, good + bad)
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (3, 1), (3, 2)]
    assert {r.n for r in found} == {3}
    assert run(spark, bad) == [] and run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0])] * 3) == []  # nothing varies
    flat = run(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
    # far from the origin: sums stay exact, and what no long can hold is null
    far = run(spark, [(i, [float(2**50 + i), float(i % 3)]) for i in range(6)])
    assert {r.deviation for r in far if r.vec_id == 0} == {(64 * 15) ** 2 + (64 * 6) ** 2}
    assert {r.deviation for r in run(spark, [(0, [2.0**50]), (1, [-(2.0**50)])])} == {None}


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(20)]) for i in range(200)] + [(500, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]
    found = queries.QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    assert len(found) == 200 * 16
    got = {(r.vec_id, r.component): r for r in found}
    for (_, component), (i, n, deviation, white, explained) in brute(rows).items():
        r = got[i, component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(white, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
