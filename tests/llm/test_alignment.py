"""Alignment of tokenizers against marking every byte, and counts against plain dictionaries."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pricetide.llm import alignment, bpe, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ZEROS = (0, 0, 0, 0, 0, 0, "")


def tokens(text, a, b):
    """``(id, bytes)`` of either side, in order."""
    shown = {c: i for i, c in enumerate(bpe.byte_letters())}
    first = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.IsByte(i) else piece.replace("▁", " ").encode()))
    return first, second


def brute(rows):
    """Per row the contract's numbers, byte by byte and link by link."""
    a, b = Tokenizer.from_file(FILES[0]), SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    links, out = [], []
    for _, text in rows:
        first, second = tokens(text, a, b) if text else ([], [])
        want = b" " + (text or "").encode()
        if not text or any(b"".join(t for _, t in side) != want for side in (first, second)):
            links.append(Counter())
            out.append(None)
            continue
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (first, second)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = [[[] for _ in cuts] for _ in range(2)]
        for k, side in enumerate((first, second)):
            for (token, _), end in zip(side, ends[k], strict=True):
                sides[k][bisect_left(cuts, end)].append(token)
        links.append(Counter((x, y) for xs, ys in zip(*sides, strict=True) for x in xs for y in ys))
        out.append((len(first), len(second), len(cuts), sides))
    held = Counter(p for found in links for p in found)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    result = []
    for (i, _), given, found in zip(rows, out, links, strict=True):
        if given is None:
            result.append((i, *ZEROS))
            continue
        written = ";".join("|".join(",".join(map(str, s)) for s in both) for both in zip(*given[3], strict=True))
        n_best = sum(t for p, t in found.items() if held[p] == highest[p[0]])
        result.append((i, *given[:3], sum(found.values()), n_best, sum(t * held[p] for p, t in found.items()), written))
    return sorted(result, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def run(spark, rows, frequent=alignment.FREQUENT):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, pairs string, key string, n_a string")
    vocabulary = alignment.load(*FILES)
    aligned = alignment.align(docs.select("doc_id", "text"), vocabulary, ["doc_id"])
    found = alignment.with_counts(aligned, vocabulary, [c for c in COLUMNS if c not in ("n_best", "count_sum")], frequent)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def corpus():
    draw = random.Random(6)
    words = ["the", "Straße", "naïve", "don't", "<|endoftext|>", "</s>", "日本語", "word", "  ", "\u3000", "   b", "wörter", "x" * 40, "3.1415", "😀", "​", "antidisestablishment"]
    texts = [
        draw.choice(["", " ", "\n"]) + draw.choice([" ", "  ", "\n\n", "\t", ""]).join(draw.choices(words, k=draw.randint(1, 30))) for _ in range(60)
    ]
    texts += ["a▁b", "▁", "", None, " ", "  ", "\x00", "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(300)), "é", texts[0]]
    return [*enumerate(texts), (None, "the word"), (3, "the same id")]


@pytest.mark.parametrize("frequent", [0, 40, alignment.FREQUENT])
def test_equals_marking_every_byte(spark, frequent):
    rows = corpus()
    assert run(spark, rows, frequent) == brute(rows)


def test_groups_of_random_cuts(monkeypatch):
    draw = random.Random(9)
    for turn in range(60):
        ends_a, ends_b, texts_a, texts_b, want_a, want_b, at = [], [], [0], [0], [], [], 0
        for _ in range(draw.randint(1, 6)):
            size = draw.randint(1, 60)
            dense_a, dense_b = draw.random(), draw.random()
            low = at
            cut_a = {p for p in range(at + 1, at + size) if draw.random() < dense_a} | {at + size}
            cut_b = {p for p in range(at + 1, at + size) if draw.random() < dense_b} | {at + size}
            for cut in sorted(cut_a & cut_b):
                want_a.append(len(ends_a) + sum(p <= low for p in cut_a))
                want_b.append(len(ends_b) + sum(p <= low for p in cut_b))
                low = cut
            ends_a += sorted(cut_a)
            ends_b += sorted(cut_b)
            texts_a.append(len(ends_a))
            texts_b.append(len(ends_b))
            at += size
        found = alignment.groups(*map(np.array, (ends_a, ends_b, texts_a, texts_b)))
        assert [f.tolist() for f in found] == [want_a, want_b], turn


@pytest.mark.parametrize("bound", [(4_096, 2_000_000), (3, 5), (0, 1)])
def test_pairs_of_links(monkeypatch, bound):
    monkeypatch.setattr(alignment, "WIDE_GROUP", bound[0])
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", bound[1])
    draw = random.Random(2)
    sides = [([draw.randrange(5) for _ in range(draw.randint(1, 6))], [draw.randrange(7) for _ in range(draw.randint(1, 6))]) for _ in range(50)]
    text = np.sort([draw.randrange(4) for _ in sides])
    want = Counter(int(t) * 35 + a * 7 + b for t, (x, y) in zip(text, sides, strict=True) for a in x for b in y)
    begins = [np.cumsum([0, *(len(s[k]) for s in sides)])[:-1] for k in (0, 1)]
    ids = [np.array([i for s in sides for i in s[k]]) for k in (0, 1)]
    keys, times = alignment.linked_pairs(*ids, *begins, text, 7, 35)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want and keys.tolist() == sorted(want)
    back = alignment.unpacked(alignment.packed(keys, times))
    assert [b.tolist() for b in back] == [keys.tolist(), times.tolist()]


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "word " * 200_000), (2, "ab" * 300_000), (3, "日" * 50_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, *ZEROS)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    names = [*COLUMNS[:-1], "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in found), key=str) == sorted(((*w[:-1], digest(w[-1])) for w in brute(rows)), key=str)
