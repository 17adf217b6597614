"""Encoding against the tokenizers library, decoding against the text."""

import random

import pytest

from pricetide.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def split(found):
    ids, counts = found
    ends = counts.cumsum().tolist()
    return [ids[low:high].tolist() for low, high in zip([0, *ends[:-1]], ends, strict=True)]


ODD = [
    "", " ", "\n\n  x", "it's we'll I'VE don't", "a<|endoftext|>b <|endoftext|> ", "<|endoftext|><|endoftext|>", "<|endoftext|", "\x00\x1f\x85  x",
    "naïve 日本語 🙂👩‍👩‍👧 Ωmega ١٢٣ ½²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ab" * 3000, "!!!???...", "  leading and trailing  ", "\t\ttabs\r\n", "﻿bom",
    "x" * 20_000 + "y", "​‍", "1234567890 12 3", "áé", "\x1c\x1d\x1e\x1fz  \x1c y",
]


def test_equals_the_library(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    draw = random.Random(4)
    pool = "abcdeéßñ ABC'\n\t .,!0123٣日🙂  \x85st"
    texts = ODD + ["".join(draw.choices(pool, k=draw.randint(1, 80))) for _ in range(1500)]
    texts += [chr(c) + " " + chr(c) + chr(c) + "a" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    found = split(encoder(texts))
    for text, ids, want in zip(texts, found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids, repr(text)
        assert bpe.decoded(ids, vocabulary["tokens"]) == library.decode(ids, skip_special_tokens=False), repr(text)


def test_merging_equals_scanning_for_the_lowest_rank():
    draw = random.Random(9)
    merges, fresh = {}, 300
    for rank in range(60):
        key = draw.randrange(6 if rank < 20 else fresh) << bpe.SHIFT | draw.randrange(6 if rank < 20 else fresh)
        if key not in merges:
            merges[key] = (rank, fresh)
            fresh += 1
    for _ in range(300):
        symbols = [draw.randrange(6) for _ in range(draw.randint(2, 40))]
        slow = list(symbols)
        while found := [(merges[a << bpe.SHIFT | b][0], i) for i, (a, b) in enumerate(zip(slow, slow[1:], strict=False)) if a << bpe.SHIFT | b in merges]:
            i = min(found)[1]
            slow[i : i + 2] = [merges[slow[i] << bpe.SHIFT | slow[i + 1]][1]]
        assert bpe.merge(list(symbols), merges) == slow
        whole = {"of_byte": list(range(256)), "merges": {k: v for k, v in merges.items()}}
        assert split(bpe.Merger(whole).same_width([bytes(symbols)] * 3, 64)) == [slow] * 3


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    small, large = bpe.Encoder(vocabulary), bpe.Encoder(vocabulary)
    for text in ("one two three", "three two one", "four one two", "one"):
        assert split(small([text])) == split(bpe.Encoder(vocabulary)([text])) == split(large([text]))


def test_tables(spark, vocabulary, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, ODD[3], ODD[3]])] + [(None, "null id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    encoded = bpe.encode(docs, vocabulary, ["doc_id", "row", "text"])
    got = bpe.decode(encoded, vocabulary, ["doc_id", "row", "text", "ids"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (r["text"] or "") and list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), vocabulary, ["doc_id"]).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [-1, 10**6]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(odd, vocabulary, ["doc_id"]).collect()} == {1: None, 2: "", 3: ""}
