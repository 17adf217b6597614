"""Document quality: random-indexing word vectors, pooled, then a small calibrated network.

Word vectors.  Every token has a sparse random vector that follows from its hash
(``NONZEROS`` entries of +1 or -1 in ``DIMS``).  A token's vector is the sum of
the random vectors of its neighbours up to ``REACH`` tokens away, over the whole
corpus, at unit length.  Tokens share ``VOCABULARY`` hashed rows, so the vectors are a
table of fixed size whatever the corpus.

Pooling.  A document is the mean of its tokens' vectors and the mean of the
products of the random vectors of adjacent tokens, which tells repetition.

Network.  Two layers in numpy, fitted on at most about ``MAX_LABELLED`` labelled
rows, with the temperature of its probabilities chosen on a part that the
weights have not seen.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import carried
from pricetide.llm.words import BLANK, U, blocks, join_texts, span_hashes, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 32
NONZEROS = 2
REACH = 2
VOCABULARY = 4096
HIDDEN = 32
MAX_LABELLED = 12_000
EPOCHS = 40
#: Byte classes; a token is a run of bytes of one class other than blank.
KIND = np.full(256, 3, np.int8)
KIND[BLANK] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


@dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.spread
        logit = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -50, 50)))


def tokens(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token in order: the index of its text, and its hash."""
    data, begins = join_texts(encoded)
    kind = KIND[data]
    starts = np.flatnonzero((kind != 0) & (np.concatenate([[0], kind[:-1]]) != kind))
    ends = np.flatnonzero((kind != 0) & (np.concatenate([kind[1:], [0]]) != kind)) + 1
    return np.searchsorted(begins, starts, side="right") - 1, span_hashes(data, starts, ends)


def random_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each token's random vector, both (tokens, NONZEROS)."""
    shifts = np.arange(NONZEROS, dtype=U) * U(8) + U(16)
    bits = hashes[:, None] >> shifts
    return (bits & U(DIMS - 1)).astype(np.int64), 1.0 - 2.0 * ((bits >> U(7)) & U(1)).astype(np.float32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all texts of a task: one row per vocabulary row."""
    total = np.zeros(VOCABULARY * DIMS)
    for batch in batches:
        for _, encoded in blocks(batch.column(0).to_pylist()):
            text, hashed = tokens(encoded)
            row = (hashed & U(VOCABULARY - 1)).astype(np.int64) * DIMS
            at, sign = random_entries(hashed)
            for gap in range(1, REACH + 1):
                same = text[:-gap] == text[gap:]
                for low, high in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
                    cell = (row[low][:, None] + at[high])[same].ravel()
                    total += np.bincount(cell, sign[high][same].ravel(), minlength=len(total))
    used = np.flatnonzero(total.reshape(VOCABULARY, DIMS).any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), *(pa.array(c) for c in total.reshape(VOCABULARY, DIMS)[used].T)],
        names=["row", *(f"d{i}" for i in range(DIMS))],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of token vectors, learned from the text of every row; ``VOCABULARY`` rows come to the driver."""
    schema = "row long, " + ", ".join(f"d{i} double" for i in range(DIMS))
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_contexts, schema)
    out = np.zeros((VOCABULARY, DIMS))
    for r in rows.groupBy("row").agg(*(F.sum(f"d{i}") for i in range(DIMS))).collect():
        out[r[0]] = r[1:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row per text; a text without tokens has zeros."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for start, encoded in blocks(texts):
        text, hashed = tokens(encoded)
        if not len(text):
            continue
        present, first = np.unique(text, return_index=True)
        count = np.diff(np.append(first, len(text)))[:, None]
        pooled = np.add.reduceat(vectors[(hashed & U(VOCABULARY - 1)).astype(np.int64)], first, axis=0) / count
        at, sign = random_entries(hashed)
        paired = np.zeros((len(encoded), DIMS), np.float32)
        for i in range(NONZEROS):
            for j in range(NONZEROS):
                hit = (text[:-1] == text[1:]) & (at[:-1, i] == at[1:, j])
                cell = text[:-1][hit] * DIMS + at[:-1, i][hit]
                paired += np.bincount(cell, (sign[:-1, i] * sign[1:, j])[hit], minlength=paired.size).reshape(paired.shape)
        out[start + present, :DIMS] = pooled
        out[start + present, DIMS:] = paired[present] / count
    return out


def _pool(vectors, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = features(batch.column(carried).to_pylist(), vectors.value).astype(np.float64)
            ends = pa.array(np.arange(len(pooled) + 1, dtype=np.int32) * 2 * DIMS)
            lists = pa.ListArray.from_arrays(ends, pa.array(pooled.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], lists], names=[*batch.schema.names[:carried], "features"])

    return run


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Model:
    """Adam on cross-entropy, then a temperature from every fifth row, which the weights have not seen."""
    draw = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    center, spread = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    z = (x - center) / spread
    weights = [
        draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(()),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rows = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(rows), max(1, len(rows) // 128)):
            step += 1
            w1, b1, w2, b2 = weights
            h = np.tanh(z[part] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50))) - y[part]) / len(part)
            back = np.outer(error, w2) * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ error + 1e-4 * w2, error.sum()]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = weights
    model = Model(vectors, center, spread, w1, b1, w2, float(b2), 1.0)
    if held.any():
        logit = np.tanh(z[held] @ w1 + b1) @ w2 + b2

        def loss(t: float) -> float:
            return float(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t).sum())

        model.temperature = min(np.geomspace(0.5, 10, 60).tolist(), key=loss)
    return model


def constant(share: float, vectors: np.ndarray) -> Model:
    """For labels of one class or none: the same score for every text."""
    n = 2 * DIMS
    return Model(vectors, np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> Model:
    """A model from the texts of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    The word vectors are learned from all texts.  The network learns from rows
    with a label of 0 or 1 for which ``learn_from`` (a condition on ``doc_id``) holds; an
    id with several labels has the lowest.  If more than ``MAX_LABELLED`` rows are
    labelled, about that many are drawn by a hash of the id.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    marked = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if learn_from is not None:
        marked = marked.where(learn_from)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, MAX_LABELLED / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    taught = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(marked), "doc_id")  # about MAX_LABELLED rows of two numbers
        .select("doc_id", "quality", "text")
        .mapInArrow(_pool(spark.sparkContext.broadcast(vectors), 2), "doc_id long, quality int, features array<double>")
        .collect()
    )
    taught.sort(key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([r["quality"] for r in taught], float)
    if len(set(y)) < 2:
        return constant((y.sum() + 1) / (len(y) + 2), vectors)
    return train(np.array([r["features"] for r in taught]), y, vectors)


def _score(found, at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**found.value)
        for batch in batches:
            given = model.scores(features(text_of(batch, at).to_pylist(), model.vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(given)], names=["row", "score"])

    return run


def classify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs``, with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on).

    Every row is scored by its whole text alone; a text that is null, empty or
    blank has the score of a document without tokens.
    """
    found = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows, at = carried(docs, carry)
    out = rows.mapInArrow(_score(found, at), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
