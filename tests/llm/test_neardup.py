"""Near-duplicate groups against comparing every pair."""

import random

import numpy as np
import pytest

from pricetide.llm import neardup
from pricetide.llm.components import components
from pricetide.llm.words import shingle_sets

SCHEMA = "doc_id long, text string, buckets string, rep string"


def brute(rows, k):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}

    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets if i is not None)


def run(spark, rows, k=4):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in neardup.near_duplicates(df, k).collect())


def corpus(seed, groups=12, size=14):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([2, 3, 4, 5, 30, 120]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = word()
            rows.append(draw.choice([" ", "  \n", "\t"]).join(copy).replace("a", draw.choice("aA")))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_every_pair(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 4)


def test_other_shingle_length(spark):
    rows = corpus(7, groups=5)
    assert run(spark, rows, 2) == brute(rows, 2)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (3, "ONE  two"), (9, "one"), (10, long), (11, long + " more"),
        (12, "a b c d e f"), (12, "a b c d e f"), (13, "É a b c"), (14, "é a b c"), (15, "x y"), (16, "x y"),
    ]
    got = run(spark, rows)
    assert got == brute(rows, 4)
    assert {r[0]: r[2] for r in got}[8] == 3 and {r[0]: r[2] for r in got}[11] == 10


def test_null_ids_stand_alone(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(rows, 4).collect()}
    assert got[2]["component_id"] == 1 and not got[2]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    words = [f"t{i}" for i in range(900)]
    a, b = shingle_sets([" ".join(words[:800]).encode(), " ".join(words[100:]).encode()], 1)
    cells = neardup.sketches([a, b, a[:1]], 400)
    assert (cells != np.iinfo(np.uint64).max).all()
    assert abs((cells[0] == cells[1]).mean() - 700 / 900) < 0.1


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1090)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    linked = {x for a, b in edges if a != b and a is not None and b is not None for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
