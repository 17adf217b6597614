"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Texts are joined into one byte array, so the work per byte is a handful of
vectorised operations.  Words are runs of bytes other than the ASCII blanks
(0x20, 0x09-0x0D); A-Z are lower-cased, other letters stay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers need not have this package installed: the helpers travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
BLOCK_BYTES = 512 << 10
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_CODES = np.random.default_rng(20_240_601).integers(0, 2**64, 256, dtype=U)


def text_of(batch: pa.RecordBatch, at: int | None) -> pa.Array:
    """The texts of a batch of ``common.carried`` rows."""
    return batch.column(1) if at is None else batch.column(0).field(at)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: list[str | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes each: first position, encoded texts (null: empty)."""
    start, size, out = 0, 0, []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        out.append(data)
        size += len(data)
        if size >= most:
            yield start, out
            start, size, out = start + len(out), 0, []
    if out:
        yield start, out


def join_texts(encoded: list[bytes], separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by the separator, and the position at which each text begins."""
    data = np.frombuffer(separator.join([*encoded, b""]), np.uint8)
    lengths = np.fromiter((len(x) for x in encoded), np.int64, len(encoded)) + len(separator)
    return data, np.concatenate([[0], np.cumsum(lengths)])[:-1]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans must not touch one another's bytes and be in order."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    coded = (BYTE_CODES[data[at]] ^ (within.astype(U) * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)
    coded ^= coded >> U(32)
    return mix(np.add.reduceat(coded * U(0xD6E8FEB86659FD93), first) + lengths.astype(U))


def hashed_words(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word in order: the index of its text, and its hash."""
    data, begins = join_texts([x.lower() for x in encoded])
    starts, ends = runs(~BLANK[data])
    return np.searchsorted(begins, starts, side="right") - 1, span_hashes(data, starts, ends)


def distinct(items: np.ndarray) -> np.ndarray:
    """The different items, in order."""
    ordered = np.sort(items)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]]


def shingle_sets(encoded: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct ``k``-word shingles as sorted hashes; fewer words: the whole sequence as one."""
    text, word = hashed_words(encoded)
    bounds = np.searchsorted(text, np.arange(len(encoded) + 1))
    chained, upto = word.copy(), [word]
    for step in range(1, k):
        chained = mix(chained[: max(len(word) - step, 0)] * U(0x9E3779B97F4A7C15) + word[step:])
        upto.append(chained)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= k:
            sets.append(distinct(chained[low : high - k + 1]))
        else:
            sets.append(upto[high - low - 1][low : low + 1] if high > low else word[:0])
    return sets
