"""Packing against a slow best-fit, and what every packing must hold to."""

import random
from collections import defaultdict

import pytest

from pricetide.llm import packing, queries


def slow(lengths, sources, clusters, capacity):
    bins, chosen = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        fits = [
            (capacity - sum(x[0] for x in b), i)
            for i, b in enumerate(bins)
            if sum(x[0] for x in b) + length <= capacity
            and not any((source is not None and x[1] == source) or (cluster is not None and x[2] == cluster) for x in b)
        ]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((length, source, cluster))
        chosen.append(i)
    return chosen


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_slow_way(seed):
    draw = random.Random(seed)
    lengths = sorted((draw.randint(0, 100) for _ in range(200)), reverse=True)
    sources = [draw.choice([None, "hot", "hot", "a", "b", *"cdefgh"]) for _ in lengths]
    clusters = [draw.choice([None, 1, 2, draw.randrange(100)]) for _ in lengths]
    assert packing.pack(lengths, sources, clusters, 100) == slow(lengths, sources, clusters, 100)


def check(rows, docs, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        parts[r["doc_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["slot"])
        assert sum(r["length"] for r in held) <= capacity
        assert [r["slot"] for r in held] == list(range(len(held)))
        assert [r["at"] for r in held] == [sum(x["length"] for x in held[:i]) for i in range(len(held))]
        for key in ("source", "cluster"):
            values = [r[key] for r in held if r[key] is not None]
            assert len(values) == len(set(values))
    for i, text in docs:
        own = sorted(parts[i], key=lambda r: r["part"])
        assert "".join((text or "")[r["start"] : r["start"] + r["length"]] for r in own) == (text or "")


def test_every_piece_once_and_no_conflicts(spark):
    draw = random.Random(5)
    docs = [(i, draw.choice([None, "", "é" * draw.randint(1, 400), "copy"]), draw.choice([None, "hot", "hot", "s1", "s2", "s3"])) for i in range(600)]
    df = spark.createDataFrame([(*d, "extra", 7) for d in docs], "doc_id long, text string, source string, bin_id string, whole int")
    rows = packing.pack_documents(df, capacity=100, per_task=150).collect()
    check(rows, [(i, t) for i, t, _ in docs], 100)


def test_repeated_rows_null_ids_and_given_clusters(spark):
    df = spark.createDataFrame([(1, "ab", "s", 5)] * 3 + [(None, "ab", None, 5), (2, "cd", "t", None)], "doc_id long, text string, source string, group long")
    rows = packing.pack_documents(df, capacity=10, cluster="group").collect()
    assert len(rows) == 5 and len({r["bin_id"] for r in rows if r["cluster"] == 5}) == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack_documents(df).collect() == []


def test_near_copies_of_other_sources_stay_apart(spark, tmp_path):
    draw = random.Random(8)
    text = " ".join(f"w{draw.randint(0, 999)}" for _ in range(120))
    near = text.replace(" ", "  ", 3) + " end"
    docs = [(1, text, "a"), (2, near, "b"), (3, near, "c"), (None, text, "d"), (None, near, "e"), (4, "other words stand here now", "f"), (5, " ", "g"), (6, " ", "h"), (7, "", "i"), (8, None, "j")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) and rows[0].__fields__[-1] == "cluster"
    copies = [r for r in rows if r["source"] in "abcde"]
    assert len({r["cluster"] for r in copies}) == 1 and len({r["bin_id"] for r in copies}) == 5
    blank = {r["cluster"] for r in rows if r["source"] in "gh"}
    assert len(blank) == 1 and blank.isdisjoint({r["cluster"] for r in copies}) and None not in blank
    assert all(r["cluster"] is None for r in rows if r["source"] in "ij")
