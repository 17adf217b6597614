"""Byte-pair encoding and decoding with a published vocabulary.

The text is cut into pieces (words with their blank, numbers, marks, blanks).
In a piece, a segment tree holds the rank of each adjacent pair.  Its root is
the lowest rank, the leftmost of equals; a merge changes three leaves and the
nodes above them, and the tree says at once when no pair is left.  So a piece
of n bytes costs n log n whatever it holds.  Short pieces of about one length
go together, a tree in each row of an array.

Pieces repeat, so each Python worker remembers what it encoded: two
generations of about ``REMEMBERED`` pieces, the older of which is dropped when the
younger is full.

The vocabulary file is read on the driver and broadcast (a fixed size whatever
the corpus), so executors need no file of their own.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import carried
from pricetide.llm.words import text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The published splitting pattern of byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 150_000
#: Characters that are encoded together, about.
BATCH_CHARS = 500_000
#: Pieces of more bytes are merged one by one.
WIDEST = 64
SHIFT = 20
#: The rank of a pair that does not merge.
NONE = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding and decoding need of a byte-level vocabulary file, as plain values."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, before = given["model"], given["pre_tokenizer"]
    plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before.get("use_regex", True) and not given["normalizer"]
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    odd += [t[k] for t in given["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if not plain or any(odd) or before.get("add_prefix_space"):
        raise ValueError("only plain byte-level vocabularies are supported")
    ids, letters = model["vocab"], byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(ids[a] << SHIFT | ids[b], (rank, ids[a + b]))
    tokens = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
    added = {t["content"]: t["id"] for t in given["added_tokens"]}
    tokens |= {i: content.encode() for content, i in added.items()}
    return {
        "of_byte": [ids[c] for c in letters], "merges": merges, "added": added,
        "tokens": [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)],
    }


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the adjacent pair of lowest rank, the leftmost first, until none is left."""
    n = len(symbols)
    size = 1 << max(n - 2, 0).bit_length()
    none = 1 << 62
    found = [merges.get(symbols[i] << SHIFT | symbols[i + 1]) for i in range(n - 1)]
    tree = [none] * size + [none if f is None else f[0] * size + i for i, f in enumerate(found)] + [none] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] < none:
        at = tree[1] % size
        second = after[at]
        symbols[at] = merges[symbols[at] << SHIFT | symbols[second]][1]
        symbols[second] = -1
        third = after[at] = after[second]
        if second < n - 1:
            put(second, none)
        if third < n:
            before[third] = at
            pair = merges.get(symbols[at] << SHIFT | symbols[third])
            put(at, none if pair is None else pair[0] * size + at)
        else:
            put(at, none)
        first = before[at]
        if first >= 0:
            pair = merges.get(symbols[first] << SHIFT | symbols[at])
            put(first, none if pair is None else pair[0] * size + first)
    return [s for s in symbols if s >= 0]


class Merger:
    """Pieces as bytes to ids, many at a time: the same segment trees as in ``merge``, one per row of an array."""

    def __init__(self, vocabulary: dict):
        self.merges, self.of_byte = vocabulary["merges"], np.array(vocabulary["of_byte"], np.int64)
        pairs = sorted((key, rank, merged) for key, (rank, merged) in self.merges.items())
        self.keys = np.array([p[0] for p in pairs] + [1 << 62], np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [0], np.int64)
        self.merged = np.zeros(max((p[1] for p in pairs), default=0) + 1, np.int64)
        for _, rank, merged in pairs:
            self.merged[rank] = merged
        every = np.arange(256)
        self.of_bytes = self.rank_of(self.of_byte[every[:, None]], self.of_byte[every[None, :]])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NONE`` for pairs that do not merge."""
        key = left << SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def same_width(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one piece after another, and how many each piece has; pieces of at most ``width`` bytes, a power of two."""
        rows, count = np.arange(len(pieces)), np.array([len(p) for p in pieces])
        place = np.arange(width)
        inside = place < count[:, None]
        raw = np.zeros((len(pieces), width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.where(inside, self.of_byte[raw], -1)
        after, before = np.tile(place + 1, (len(pieces), 1)), np.tile(place - 1, (len(pieces), 1))
        tree = np.full((len(pieces), 2 * width), NONE * width, np.int64)
        pair = inside[:, 1:]
        rank = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        tree[:, width:-1] = np.where(pair & (rank < NONE), rank * width + place[:-1], NONE * width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[row, node] = value
            while node[0] > 1:  # all leaves are at one depth
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = rows[tree[:, 1] < NONE * width]
        while len(row):
            root = tree[row, 1]
            at = root % width
            second = after[row, at]
            third = after[row, second]
            new = self.merged[root // width]
            symbols[row, at] = new
            symbols[row, second] = -1
            after[row, at] = third
            put(row, second, np.full(len(row), NONE * width))
            more = third < count[row]
            value = np.full(len(row), NONE * width)
            r, t = row[more], third[more]
            before[r, t] = at[more]
            ahead = self.rank_of(new[more], symbols[r, t])
            value[more] = np.where(ahead < NONE, ahead * width + at[more], NONE * width)
            put(row, at, value)
            first = before[row, at]
            some = first >= 0
            if some.any():
                r, f = row[some], first[some]
                behind = self.rank_of(symbols[r, f], new[some])
                put(r, f, np.where(behind < NONE, behind * width + f, NONE * width))
            row = row[tree[row, 1] < NONE * width]
        alive = symbols >= 0
        return symbols[alive], alive.sum(axis=1)

    def __call__(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in another order, their ids one after another, and how many each has."""
        encoded = [p.encode("utf-8") for p in pieces]
        by_width: dict[int, list[int]] = {}
        for i, data in enumerate(encoded):
            by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append(i)
        order, ids, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, rows in by_width.items():
            if width > WIDEST:
                for i in rows:
                    ids.append(np.array(merge(self.of_byte[np.frombuffer(encoded[i], np.uint8)].tolist(), self.merges)))
                    counts.append(np.array([len(ids[-1])]))
                order += rows
                continue
            for start in range(0, len(rows), 8192):
                part = rows[start : start + 8192]
                flat, each = self.same_width([encoded[i] for i in part], width)
                order += part
                ids.append(flat)
                counts.append(each)
        return [pieces[i] for i in order], np.concatenate(ids), np.concatenate(counts)


class Remembered:
    """Ids of pieces: a place for each piece, and arrays of where its ids begin and how many they are."""

    def __init__(self) -> None:
        self.place: dict[str | int, int] = {}
        self.begin, self.count, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, pieces: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, ids])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces at these places, one after another, and how many each has."""
        counts = self.count[at]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(self.begin[at], counts) + within], counts


class Encoder:
    """Texts to ids; added tokens' strings in a text are those tokens."""

    def __init__(self, vocabulary: dict):
        self.merger, self.added = Merger(vocabulary), vocabulary["added"]
        self.met, self.older = Remembered(), Remembered()
        self.cut = regex.compile(PIECES).findall
        apart = sorted(self.added, key=len, reverse=True)
        self.apart = regex.compile("|".join(map(regex.escape, apart))) if apart else None

    def pieces(self, text: str) -> list[str | int]:
        """The pieces of a text; an added token is its id already."""
        if self.apart is None or not self.apart.search(text):
            return self.cut(text)
        out, at = [], 0
        for hit in self.apart.finditer(text):
            out += self.cut(text[at : hit.start()])
            out.append(self.added[hit.group()])
            at = hit.end()
        return out + self.cut(text[at:])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and how many each has."""
        cut = [self.pieces(t) for t in texts]
        if len(self.met.place) > REMEMBERED:
            self.met, self.older = Remembered(), self.met
        new = set().union(*cut) - self.met.place.keys()
        again = [p for p in new if p in self.older.place]
        self.met.add(again, *self.older.gather(np.array([self.older.place[p] for p in again], np.int64)))
        new.difference_update(again)
        added = [p for p in new if isinstance(p, int)]
        self.met.add(added, np.array(added, np.int64), np.ones(len(added), np.int64))
        self.met.add(*self.merger([p for p in new if isinstance(p, str)]))
        place = self.met.place
        sizes = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        ids, counts = self.met.gather(at)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])


def decoded(ids: list[int], tokens: list[bytes]) -> str:
    """The text of a sequence of ids, added tokens included; unknown ids are left out, broken UTF-8 becomes U+FFFD."""
    return b"".join([tokens[i] for i in ids if 0 <= i < len(tokens)]).decode("utf-8", "replace")


def _encode(shared, at: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value  # a worker's copy outlives its tasks, and so does what the encoder remembers
        encoder = vocabulary.setdefault("encoder", None) or Encoder(vocabulary)
        vocabulary["encoder"] = encoder
        for batch in batches:
            done, texts, held = 0, [], 0
            for row, text in enumerate(text_of(batch, at), start=1):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS or row == batch.num_rows:
                    ids, counts = encoder(texts)
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists], names=["row", "ids"])
                    done, texts, held = row, [], 0

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value["tokens"]
        for batch in batches:
            texts = [decoded(ids.values.to_numpy().tolist(), tokens) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: dict, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs(text)`` with ``ids``: the whole text's token ids; a null or empty text has none."""
    shared = docs.sparkSession.sparkContext.broadcast({k: vocabulary[k] for k in ("of_byte", "merges", "added")})
    rows, at = carried(docs, carry)
    out = rows.mapInArrow(_encode(shared, at), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")
    return out.select("row.*", "ids")


def decode(docs: DataFrame, vocabulary: dict, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs(ids)`` with ``decoded``, the text of the ids; null ids stay null."""
    shared = docs.sparkSession.sparkContext.broadcast({"tokens": vocabulary["tokens"]})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("ids").cast("array<int>").alias("ids"))
    out = rows.mapInArrow(_decode(shared), f"row {rows.schema['row'].dataType.simpleString()}, decoded string")
    return out.select("row.*", "decoded")
