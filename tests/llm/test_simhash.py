"""SimHash groups against fingerprints bit by bit and comparing every pair."""

import random
import re

import numpy as np
import pytest
import xxhash

from pricetide.llm import queries, simhash

SCHEMA = "doc_id long, text string, fp string, anchor string"


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(words, bits=2):
    """The smallest word reachable from each, by comparing every pair."""
    words = sorted(set(words))
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(words):
        for b in words[:n]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {w: find(w) for w in words}


def brute(rows):
    words = {i: fingerprint(t) for i, t in rows}
    label = classes(words.values())
    least = {}
    for i, w in words.items():
        least[label[w]] = min(i, least.get(label[w], i))
    return sorted((i, f"{w:016x}", least[label[w]]) for i, w in words.items())


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(df, **kw).collect()
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found), key=str)


def test_equals_comparing_every_pair(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(10):
        base = [draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(draw.choice([1, 2, 3, 6, 60, 300]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2])):
                copy[draw.randrange(len(copy))] = draw.choice("ijkl")
            rows.append(draw.choice([" ", "\t\x0b ", "\n"]).join(copy).replace("a", draw.choice("aA")))
    rows = list(enumerate(rows))
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert len({c for _, _, c in brute(rows)}) < len(rows)


@pytest.mark.parametrize("homes", [0, 3, 10**6])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_of_words_equal_every_pair(spark, homes, bits):
    """Crowded anchors and others, around one centre and far from any."""
    draw = random.Random(homes + bits)
    words = {draw.getrandbits(64) for _ in range(50)}
    for centre in (0, 2**64 - 1, draw.getrandbits(64)):
        for _ in range(60):
            word = centre
            for _ in range(draw.randint(0, 3)):
                word ^= 1 << draw.randrange(64)
            words.add(word)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    df = spark.createDataFrame([(signed(w),) for w in sorted(words)], "fp long")
    edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, bits=bits, homes=homes).collect()]
    assert all(0 < (u ^ v).bit_count() <= bits for u, v in edges)
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    assert {w: find(w) for w in words} == classes(words, bits)
    if homes == 10**6:
        every = {(min(a, b), max(a, b)) for a in words for b in words if 0 < (a ^ b).bit_count() <= bits}
        assert {(min(e), max(e)) for e in edges} == (every if bits else set()) and len(edges) == len(every)


def test_anchors_cover_radius_and_threshold():
    tables = [simhash.errors(*block, 2) for block in simhash.CODE]
    draw = np.random.default_rng(3)
    words = np.concatenate([draw.integers(0, 2**64, 400, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    row, anchor, home = simhash.anchors(words, tables)
    assert home.sum() == len(words) and len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
    reached = set(zip(row.tolist(), anchor.tolist()))
    near = words.copy()
    for i in range(len(near)):
        for place in draw.choice(64, draw.integers(0, 3), replace=False):
            near[i] ^= np.uint64(1 << int(place))
    row, anchor, home = simhash.anchors(near, tables)
    assert all((r, a) in reached for r, a in zip(row[home].tolist(), anchor[home].tolist()))
    with pytest.raises(ValueError):
        simhash.errors(8, 0b111111111, 3, 2)


def test_counts_of_many_hashes():
    draw = np.random.default_rng(4)
    sizes = np.array([0, 1, 2, 254, 255, 256, 1000, 0, 3])
    hashes = draw.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    hashes[:300] |= np.uint64(2**63 | 1)
    ends = np.cumsum(sizes)
    want = [
        sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[e - s : e]) > s) for s, e in zip(sizes, ends, strict=True)
    ]
    assert simhash.majorities(hashes, sizes).tolist() == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "c d e f g"), (5, "A  B"), (None, "a b"), (6, long), (7, long + " end"), (7, long)]
    found = run(spark, rows)
    empty = "0" * 16
    assert [r for r in found if r[1] == empty] == [(1, empty, 1), (2, empty, 1), (3, empty, 1)]
    ab = f"{fingerprint('a b'):016x}"
    assert sorted((r for r in found if r[1] == ab), key=str) == [(4, ab, 4), (5, ab, 4), (None, ab, None)]
    assert [r[2] for r in found if r[0] in (6, 7)] == [6, 6, 6]
    assert run(spark, []) == [] and run(spark, [(None, "x")])[0][2] is None


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(8)
    texts = [" ".join(draw.choices(["one", "Two", "three", "vier", "ünf"], k=draw.randint(0, 9))) for _ in range(150)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_simhash_near_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == brute(rows)
