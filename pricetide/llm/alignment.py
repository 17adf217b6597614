"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizers cut a text's bytes into tokens.  Where a token of each ends at the
same byte, the text can be cut.  An interval of tokens is cut near its middle:
the end of its middle token is looked up among the other's ends by bisection, the
next end found there is looked up in turn, and so on until both agree; if they
first agree at the interval's end, the same goes on from the middle backwards.
Both halves are then cut likewise.  An interval without a cut inside is a group.
All intervals of one depth, of many texts, go on together in numpy arrays.

Tokens whose bytes share a group are linked.  Links are counted in two passes: the
first aligns every text and keeps its distinct pairs of ids, compressed, with
how often each occurs; the second looks up in how many texts the corpus holds each
pair.  The at most ``FREQUENT`` pairs that most texts hold, which are most of what there is to look up,
are broadcast; all rarer pairs meet their counts in a join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import bpe
from pricetide.llm.common import carried, keep
from pricetide.llm.words import text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of ids whose counts are broadcast, at most.
FREQUENT = 1 << 18
#: Bytes of text aligned at once, about.
BLOCK_BYTES = 512 << 10
#: Links listed at once; a group with more is counted by its distinct ids.
LINKS_AT_ONCE = 2_000_000
WIDE_GROUP = 4_096
#: Pairs that a task adds up before it passes them on.
PAIRS_AT_ONCE = 4_000_000


def load(byte_level: str, pieces: str) -> dict:
    """What aligning needs of a byte-level vocabulary file (A) and a sentence-piece model (B), as plain values."""
    with open(pieces, "rb") as file:
        return bpe.load(byte_level) | {"added": {}, "model": file.read()}


def _built(vocabulary: dict) -> dict:
    """The vocabulary with its encoders, from texts to all ids and how many each has, and the bytes of each token; a worker builds them once."""
    if "encode_a" in vocabulary:
        return vocabulary
    from sentencepiece import SentencePieceProcessor

    second = SentencePieceProcessor(model_proto=vocabulary["model"])
    bytes_a = vocabulary["tokens"]
    bytes_b = [
        bytes([int(p[3:5], 16)]) if second.IsByte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(second.id_to_piece(list(range(second.vocab_size()))))
    ]
    # digits with the mark that follows: within a side, at its end
    marks = [f"{i}{m}".encode() for n, ms in ((len(bytes_a), ",|"), (len(bytes_b), ",;")) for m in ms for i in range(n)]

    def encode_b(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(i, np.int64) for i in second.encode([t[1:] for t in texts], num_threads=1)]  # it adds the space
        return np.concatenate([np.zeros(0, np.int64), *ids]), np.array([len(i) for i in ids], np.int64)

    vocabulary |= {"encode_a": bpe.Encoder(vocabulary), "encode_b": encode_b, "marks": np.array(marks, object)}
    for side, tokens in (("a", bytes_a), ("b", bytes_b)):
        vocabulary[f"bytes_{side}"] = np.array([*tokens, None], object)[:-1]
        vocabulary[f"length_{side}"] = np.array([len(t) for t in tokens])
    return vocabulary


def _encoded(texts: list[bytes], ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts are the bytes of their tokens."""
    sizes = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    good = np.diff(sizes) == [len(t) for t in texts]
    joined = b"".join(tokens[ids].tolist())
    if good.all() and joined == b"".join(texts):
        return good
    return np.array([joined[a:b] == t for a, b, t in zip(sizes[:-1].tolist(), sizes[1:].tolist(), texts, strict=True)], bool)


def _meet_after(x: np.ndarray, y: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each place ``i`` of ``x`` on, the first value that ``y`` has, too: its place in either.  The last values agree."""
    i, j = i.copy(), np.searchsorted(y, x[i])
    apart = np.flatnonzero(y[j] != x[i])
    while len(apart):
        i[apart] = np.searchsorted(x, y[j[apart]])
        j[apart] = np.searchsorted(y, x[i[apart]])
        apart = apart[y[j[apart]] != x[i[apart]]]
    return i, j


def _meet_before(x: np.ndarray, y: np.ndarray, i: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each place ``i`` of ``x`` back to ``least``, the last value that ``y`` has, too; its place is below ``least`` if there is none."""
    i, j = i.copy(), np.full(len(i), -1)
    apart = np.flatnonzero(i >= least)
    while len(apart):
        j[apart] = np.searchsorted(y, x[i[apart]], side="right") - 1
        none = j[apart] < 0
        i[apart[none]] = -1
        apart = apart[~none]
        apart = apart[y[j[apart]] != x[i[apart]]]
        i[apart] = np.searchsorted(x, y[j[apart]], side="right") - 1
        apart = apart[i[apart] >= least[apart]]
    return i, j


def groups(ends_a: np.ndarray, ends_b: np.ndarray, texts_a: np.ndarray, texts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins in A's and in B's tokens, in order.

    ``ends`` are the tokens' ends among the bytes of all texts, one text after another;
    ``texts`` say where each text's tokens begin, and lastly how many tokens there are.
    Every text has a token.
    """
    a0, a1, b0, b1 = texts_a[:-1], texts_a[1:], texts_b[:-1], texts_b[1:]
    found_a, found_b = [a0[:0]], [b0[:0]]
    while len(a0):
        # an end inside needs two tokens of either
        whole = (a1 - a0 == 1) | (b1 - b0 == 1)
        found_a.append(a0[whole])
        found_b.append(b0[whole])
        a0, a1, b0, b1 = (v[~whole] for v in (a0, a1, b0, b1))
        middle = (a0 + a1 - 2) // 2
        i, j = _meet_after(ends_a, ends_b, middle)
        outer = np.flatnonzero(i >= a1 - 1)
        i[outer], j[outer] = _meet_before(ends_a, ends_b, middle[outer] - 1, a0[outer])
        uncut = i < a0
        # what lies after a cut that was found backwards has none inside
        tail = np.zeros(len(a0), bool)
        tail[outer] = ~uncut[outer]
        found_a += [a0[uncut], i[tail] + 1]
        found_b += [b0[uncut], j[tail] + 1]
        left, right = ~uncut, ~uncut & ~tail
        a0, a1, b0, b1 = (
            np.concatenate(v)
            for v in (
                (a0[left], i[right] + 1), (i[left] + 1, a1[right]), (b0[left], j[right] + 1), (j[left] + 1, b1[right]),
            )
        )
        order = np.argsort(a0, kind="stable")  # lookups in order stay in the processor's cache
        a0, a1, b0, b1 = a0[order], a1[order], b0[order], b1[order]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _counted(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of what each was counted."""
    every, weight = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    return every[first], np.add.reduceat(weight, first) if len(first) else weight


def linked_pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray, text: np.ndarray, kinds_b: int, kinds: int
) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``text * kinds + a * kinds_b + b`` of all links, in order, and how many links each stands for.

    ``begin`` say where groups begin, ``text`` which text each group is of.
    """
    many_a, many_b = np.diff(np.append(begin_a, len(ids_a))), np.diff(np.append(begin_b, len(ids_b)))
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide = many_a * many_b > WIDE_GROUP
    for g in np.flatnonzero(wide):
        a, n = np.unique(ids_a[begin_a[g] : begin_a[g] + many_a[g]], return_counts=True)
        b, m = np.unique(ids_b[begin_b[g] : begin_b[g] + many_b[g]], return_counts=True)
        keys.append((text[g] * kinds + (a[:, None] * kinds_b + b)).ravel())
        times.append((n[:, None] * m).ravel())
    group = np.repeat(np.arange(len(begin_a)), many_a)
    token = np.flatnonzero(~wide[group])
    group = group[token]
    upto = np.cumsum(many_b[group])
    start = 0
    while start < len(token):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LINKS_AT_ONCE, side="right")))
        g, a = group[start:stop], ids_a[token[start:stop]]
        count = many_b[g]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        b = ids_b[np.repeat(begin_b[g], count) + within]
        key, n = np.unique(np.repeat(text[g] * kinds + a * kinds_b, count) + b, return_counts=True)
        keys.append(key)
        times.append(n)
        start = stop
    return _counted(keys, times) if len(keys) > 2 else (keys[-1], times[-1])


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ordered pairs with their counts, as differences, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(pairs, prepend=0), times]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T
    both = np.ascontiguousarray(flat).view("<i8").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _aligned_texts(texts: list[str], vocabulary: dict) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Per text: a row of the numbers of A's and B's tokens, groups and links; the groups written out; the packed pairs."""
    numbers = np.zeros((len(texts), 4), np.int64)
    written, kept = [b""] * len(texts), [packed(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    spaced = [" " + texts[i] for i in some]
    (ids_a, many_a), (ids_b, many_b) = vocabulary["encode_a"](spaced), vocabulary["encode_b"](spaced)
    given = [t.encode() for t in spaced]
    good = np.ones(len(some), bool)
    for ids, counts, side in ((ids_a, many_a, "a"), (ids_b, many_b, "b")):
        good &= _encoded(given, ids, counts, vocabulary[f"bytes_{side}"], vocabulary[f"length_{side}"])
    use = some[good]
    if not len(use):
        return numbers, written, kept
    ids_a, ids_b = ids_a[np.repeat(good, many_a)], ids_b[np.repeat(good, many_b)]
    texts_a, texts_b = (np.concatenate([[0], np.cumsum(many[good])]) for many in (many_a, many_b))
    ends_a, ends_b = np.cumsum(vocabulary["length_a"][ids_a]), np.cumsum(vocabulary["length_b"][ids_b])
    begin_a, begin_b = groups(ends_a, ends_b, texts_a, texts_b)
    many_a, many_b = np.diff(np.append(begin_a, len(ids_a))), np.diff(np.append(begin_b, len(ids_b)))
    first = np.searchsorted(begin_a, texts_a)  # each text's first group
    numbers[use, 0], numbers[use, 1], numbers[use, 2] = np.diff(texts_a), np.diff(texts_b), np.diff(first)
    numbers[use, 3] = np.add.reduceat(many_a * many_b, first[:-1])
    # groups in writing: each token's digits and the mark after it, A's of a group before B's
    kinds_a, kinds_b = len(vocabulary["bytes_a"]), len(vocabulary["bytes_b"])
    place_a = np.arange(len(ids_a)) + np.repeat(begin_b, many_a)
    place_b = np.arange(len(ids_b)) + np.repeat(begin_a + many_a, many_b)
    mark_a, mark_b = ids_a.copy(), ids_b + 2 * kinds_a
    mark_a[begin_a + many_a - 1] += kinds_a
    mark_b[begin_b + many_b - 1] += kinds_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[place_a], order[place_b] = mark_a, mark_b
    pieces, cuts = vocabulary["marks"][order].tolist(), (texts_a + texts_b).tolist()
    text = np.repeat(np.arange(len(use)), np.diff(first))
    keys, times = linked_pairs(ids_a, ids_b, begin_a, begin_b, text, kinds_b, kinds_a * kinds_b)
    pairs, low = keys % (kinds_a * kinds_b), np.searchsorted(keys, np.arange(len(use) + 1) * (kinds_a * kinds_b))
    for n, i in enumerate(use.tolist()):
        written[i] = b"".join(pieces[cuts[n] : cuts[n + 1]])[:-1]
        kept[i] = packed(pairs[low[n] : low[n + 1]], times[low[n] : low[n + 1]])
    return numbers, written, kept


def _aligned(shared, at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _built(shared.value)
        for batch in batches:
            done, texts, held = 0, [], 0
            for row, text in enumerate(text_of(batch, at), start=1):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or row == batch.num_rows:
                    numbers, written, kept = _aligned_texts(texts, vocabulary)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(done, len(texts)), *(pa.array(numbers[:, k]) for k in range(4)),
                            pa.array(written, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()),
                        ],
                        names=["row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
                    )
                    done, texts, held = row, [], 0

    return run


def align(docs: DataFrame, vocabulary: dict, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs(text)`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and ``pairs``.

    ``groups`` is written as ``a1,a2|b1;a3|b2``: ids of A before ids of B, groups in order.  ``pairs`` is
    for ``with_counts``.  A text that is null or empty, or whose tokens' bytes are not a
    space and the text (such as one that holds U+2581, which B takes for a space), has no
    tokens: zeros and an empty string.  Each row goes by its own text; repeated rows are
    each returned.  Texts are encoded whole, whatever their length; a group's links are its
    tokens of A times those of B, so what a task holds grows with its distinct pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vocabulary))
    rows, at = carried(docs, carry)
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(
        _aligned(shared, at), f"row {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"
    )
    return out.select("row.*", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each pair is, a bounded number of pairs at a time."""

    def given(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    held, size = [], 0
    for batch in batches:
        for data in batch.column(0):
            held.append(unpacked(data.as_py())[0])
            size += len(held[-1])
            if size >= PAIRS_AT_ONCE:
                yield given(held)
                held, size = [], 0
    if held:
        yield given(held)


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = (shared.value[k] for k in ("pair", "n", "best"))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sums, rare, often, ends = np.zeros((part.num_rows, 2), np.int64), [], [], [0]
                for row, data in enumerate(part.column(1)):
                    pairs, times = unpacked(data.as_py())
                    at = np.searchsorted(known, pairs).clip(max=max(len(known) - 1, 0))
                    hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                    sums[row] = (times[hit] * counts[at[hit]]).sum(), (times[hit] * best[at[hit]]).sum()
                    rare.append(pairs[~hit])
                    often.append(times[~hit])
                    ends.append(ends[-1] + len(rare[-1]))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sums[:, 1]), pa.array(sums[:, 0]),
                        *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v))) for v in (rare, often)),
                    ],
                    names=["row", "n_best", "count_sum", "rare", "times"],
                )

    return run


def pair_counts(aligned: DataFrame, kinds_b: int) -> DataFrame:
    """``(pair, n, best)``: in how many rows of ``aligned(pairs)`` each linked pair ``a * kinds_b + b`` is, and whether no pair of that ``a`` is in more."""
    counts = keep(aligned.select("pairs").mapInArrow(_added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.floor(F.col("pair") / kinds_b).cast("long")
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", first).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, vocabulary: dict, carry: list[str], frequent: int = FREQUENT) -> DataFrame:
    """The columns ``carry`` of ``align``'s rows with ``n_best`` and ``count_sum``, as a pair's count is the number of rows that hold it linked.

    ``count_sum`` adds the counts of a row's links, ``n_best`` counts the links whose
    count is the highest of their A id, ties included.
    """
    kinds_b = len(_built(dict(vocabulary))["bytes_b"])
    names = [f"c{i}" for i in range(len(carry))]  # whatever the columns are called, they do not clash
    rows = aligned.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), "pairs")
    rows = keep(rows.withColumn("key", F.monotonically_increasing_id()))
    counts = keep(pair_counts(rows, kinds_b))
    # powers of two from the top as long as all their pairs together stay within the bound
    sizes = {r.power: r.n for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}
    least = max(sizes, default=0) + 1
    while least and sum(n for power, n in sizes.items() if power >= least - 1) <= frequent:
        least -= 1
    known = counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast({c: known.column(c).to_numpy() for c in ("pair", "n", "best")})
    sent = rows.select(F.struct("key", *names).alias("row"), "pairs")
    found = sent.mapInArrow(
        _looked_up(shared),
        f"row {sent.schema['row'].dataType.simpleString()}, n_best long, count_sum long, rare array<bigint>, times array<bigint>",
    )
    if least:  # else every pair was broadcast
        found = keep(found)
        rare = found.select("row.key", F.explode(F.arrays_zip("rare", "times")).alias("met"))
        rare = rare.select("key", F.col("met.rare").alias("pair"), F.col("met.times").alias("times")).join(counts, "pair")
        more = rare.groupBy("key").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        found = found.select("row.*", "n_best", "count_sum").join(more, "key", "left")
        n_best, count_sum = (F.col(a) + F.coalesce(b, F.lit(0).cast("long")) for a, b in (("n_best", "more_best"), ("count_sum", "more_sum")))
        found = found.select(*names, n_best.alias("n_best"), count_sum.alias("count_sum"))
    else:
        found = found.select(*(F.col(f"row.{n}") for n in names), "n_best", "count_sum")
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "n_best", "count_sum")
