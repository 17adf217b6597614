"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code.

A fingerprint of 64 bits is cut into blocks, and each block has a perfect code:
every word of the block lies within the code's radius of exactly one codeword.
The codewords of all blocks together are the anchors.  A fingerprint has one
home, the anchor within the radius in every block.  A fingerprint that differs
from it in at most ``BITS`` places exceeds the radii of that anchor by ``BITS``
in all at most.  So each fingerprint is replicated to every anchor within
covering radius plus threshold, and an anchor compares those it is home to with
those sent there.  Nothing is missed, and a pair meets where its smaller one is at
home, once.

``CODE`` has two Golay codes and two majority votes: 2^26 anchors, of which a
fingerprint reaches 71 in the mean.  Anchors that are home to more than
``HOMES`` fingerprints, as in a large group of near copies, compare no pairs:
their fingerprints go on to the anchors of the finest code, the one of radius
zero whose anchors are all words.  Two words that differ in two places or fewer have a
word between them, one place from either at most, so sending each to the 65
words about it makes them meet there, and all that meet there are linked.  At most 65
different fingerprints meet in a word, however large the group is.

Equal fingerprints take part once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import keep
from pricetide.llm.components import components
from pricetide.llm.words import U

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
BITS = 2
#: Perfect cyclic codes, one a block: length, generator polynomial, radius.  The lengths add up to 64.
GOLAY, MAJORITY = (23, 0b101011100011, 3), (9, 0b111111111, 4)
CODE = (GOLAY, GOLAY, MAJORITY, MAJORITY)
#: More fingerprints than these at home in one anchor are linked by the finest code.
HOMES = 32
#: Hashes that are counted at once, about.
HASHES_AT_ONCE = 500_000
#: Fingerprints whose anchors are listed at once.
SPREAD_ROWS = 4_096


def hashes_of(text: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of each run of ``k`` words, repeats included; of the whole sequence if it has fewer."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes, the word of the bits set in over half of them; an empty run has zero."""
    out = np.zeros(len(sizes), U)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts = np.cumsum(sizes[some]) - sizes[some]
    # sums of up to 255 hashes fit a byte, so eight counters go in one word
    parts = -(-sizes[some] // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    cuts = np.repeat(starts, parts) + 255 * within
    counts = np.zeros((len(some), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> U(shift)) & U(0x0101010101010101), cuts)
        counts[:, shift::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * counts > sizes[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, out, held = [], [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                own = hashes_of(text, k, seed) if text else []
                found.append(np.array(own, U))
                sizes.append(len(own))
                held += len(own)
                if held > HASHES_AT_ONCE or i == batch.num_rows - 1:
                    out.append(majorities(np.concatenate(found), np.array(sizes)))
                    found, sizes, held = [], [], 0
            words = np.concatenate(out) if out else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.view(np.int64))], names=["row", "fp"])

    return run


def remainders(words: np.ndarray, length: int, generator: int) -> np.ndarray:
    """Of each word as a polynomial over two elements, the remainder by the generator."""
    degree, left = generator.bit_length() - 1, words.copy()
    for place in range(length - 1, degree - 1, -1):
        left ^= ((left >> U(place)) & U(1)) * U(generator << (place - degree))
    return left


def errors(length: int, generator: int, radius: int, beyond: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For excess 0 .. ``beyond``: the error words of weight radius + excess, listed by remainder, and where each remainder's list begins.

    Excess 0 has all weights up to the radius: one word per remainder, since the code is perfect.
    """
    out = []
    for excess in range(beyond + 1):
        weights = range(radius + 1) if not excess else [radius + excess] if radius + excess <= length else []
        words = np.array([sum(1 << p for p in places) for w in weights for places in combinations(range(length), w)], U)
        rest = remainders(words, length, generator).astype(np.int64)
        kinds = 1 << (generator.bit_length() - 1)
        out.append((words[np.argsort(rest, kind="stable")], np.searchsorted(np.sort(rest), np.arange(kinds + 1))))
    if not np.array_equal(np.diff(out[0][1]), np.ones(len(out[0][1]) - 1)):
        raise ValueError("the code is not perfect")
    return out


def _listed(rows: np.ndarray, rest: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, error) of the table's list for the row's remainder."""
    words, begins = table
    low, count = begins[rest], begins[rest + 1] - begins[rest]
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(rows, count), words[np.repeat(low, count) + within]


def anchors(words: np.ndarray, tables: list, code=CODE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)``: all anchors within covering radius plus ``bits`` of each word, and whether it is at home there."""
    rests, shift = [], 0
    for length, generator, _ in code:
        rests.append((remainders((words >> U(shift)) & U((1 << length) - 1), length, generator).astype(np.int64), shift))
        shift += length
    rows = np.arange(len(words))
    home = words.copy()
    for (rest, at), table in zip(rests, tables, strict=True):
        home ^= table[0][0][rest] << U(at)
    # what turns the home into another anchor, one block after the other: rows, errors so far, excess so far
    reached = [(rows, home, np.zeros(len(words), np.int64))]
    for (rest, at), table in zip(rests, tables, strict=True):
        own = table[0][0]
        for row, anchor, spent in list(reached):
            for excess in range(1, bits + 1):
                may = spent + excess <= bits
                index, error = _listed(np.flatnonzero(may), rest[row[may]], table[excess])
                moved = anchor[index] ^ ((error ^ own[rest[row[index]]]) << U(at))
                reached.append((row[index], moved, spent[index] + excess))
    row, anchor, spent = (np.concatenate([r[i] for r in reached]) for i in range(3))
    return row, anchor, spent == 0


def _spread(code, bits: int, homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [errors(*block, 0 if homes_only else bits) for block in code]
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for start in range(0, len(whole), SPREAD_ROWS):
                words = whole[start : start + SPREAD_ROWS]
                row, anchor, _ = anchors(words, tables, code, 0 if homes_only else bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(words[row].view(np.int64))], names=["anchor", "fp"])

    return run


def links(words: DataFrame, code=CODE, bits: int = BITS, homes: int = HOMES) -> DataFrame:
    """``(u, v)``: edges between the distinct 64-bit words of ``words(fp)`` that differ in at most ``bits`` places.

    Every edge is such a pair.  Pairs are complete but where an anchor is crowded;
    there edges connect all that the pairs would.
    """
    if sum(block[0] for block in code) != 64 or not 0 <= bits <= 2:
        raise ValueError("blocks of 64 places in all, and at most 2 differing places")
    sent = "anchor long, fp long"
    at_home = words.mapInArrow(_spread(code, bits, True), sent)
    crowd = at_home.groupBy("anchor").agg((F.count("*") > homes).alias("crowded"))
    cells = at_home.join(crowd, "anchor").select("anchor", F.when(~F.col("crowded"), F.col("fp")).alias("other"))
    cells = cells.groupBy("anchor", "other").agg(F.lit(True).alias("met"))  # one row for a crowded anchor
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits
    met = words.mapInArrow(_spread(code, bits, False), sent).join(cells, "anchor")
    met = met.where(F.col("other").isNull() | (near & (F.col("other") < F.col("fp")))).select("fp", "other")
    met = keep(met.groupBy("fp", "other").agg(F.lit(True).alias("met")))
    places = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << p if p < 63 else -(1 << 63))) for p in range(64 if bits else 0)]
    between = met.where("other is null").select("fp", F.explode(F.array(*places)).alias("word"))
    # at most 65 words are one place from a word or equal to it
    gathered = between.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if bits == 1:  # words that meet between may differ in two places; one of a pair is the word itself
        near_one = F.filter("fps", lambda f: F.bit_count(f.bitwiseXOR(F.col("word"))) == 1)
        gathered = gathered.where(F.array_contains("fps", F.col("word"))).select(F.concat(F.array("word"), near_one).alias("fps"))
    first = F.col("fps")[0]
    chained = gathered.select(first.alias("u"), F.explode(F.slice("fps", 2, F.size("fps") - 1)).alias("v"))
    return met.where("other is not null").select(F.col("other").alias("u"), F.col("fp").alias("v")).union(chained)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``; ``fp`` is the fingerprint as a signed long.

    Words are runs of non-blank characters with A-Z lower-cased; runs of ``k`` words
    are hashed with every repeat.  A text with fewer words has its whole sequence
    as the only run; a text that is null or has no word has fingerprint zero and is linked
    like any other.  Equal rows get equal results, and where an id repeats each row goes
    by its own text.  A row with a null id has a fingerprint but links nothing, and its
    component is null.  Texts of any length are read whole; one is held by a task at a time.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = keep(rows.mapInArrow(_fingerprints(k, seed), "row long, fp long"))
    distinct = keep(signed.where("row is not null").groupBy("fp").agg(F.min("row").alias("least")))
    found = keep(components(links(distinct.select("fp"), bits=bits)))
    least = found.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("least").alias("component_id"))
    label = found.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    named = distinct.join(label, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    component = F.when(F.col("row").isNotNull(), F.col("component_id")).alias("component_id")
    return signed.join(named, "fp", "left").select(F.col("row").alias("doc_id"), "fp", component)
