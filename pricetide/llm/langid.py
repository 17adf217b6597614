"""Language by compression: the language whose dictionary compresses a text best.

A dictionary is raw text of one language, handed to zstandard as content that
precedes the text.  A text that shares its words and syllables becomes smaller
behind the dictionary of its own language.  Each language has ``SHARDS``
dictionaries of different texts and their sizes are added up, which resolves
short texts more finely than one compressed size in bytes could.

The dictionaries are fitted on a bounded sample: ``DOCS_PER_LANGUAGE`` rows of
each language, whatever their number, and ``CHARS_PER_DOC`` characters from the
middle of each; of a language with fewer rows as many more, so that a few long texts
teach as much as many short ones.  Every language is learned; what is kept
grows with their number, about half a megabyte each.  What is classified is
always the whole text, in chunks of ``CHUNK_BYTES``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.llm.common import carried
from pricetide.llm.words import text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNDETERMINED = "und"
SHARDS = 2
DOCS_PER_LANGUAGE = 400
CHARS_PER_DOC = 600
CHUNK_BYTES = 2 << 10
#: Bytes of difference in compressed size, over all shards, that halve a rival's share in the score.
BYTES_PER_HALVING = 2.0
#: Below this score the margin counts as narrow: two languages that tie have 0.5.
MIN_SCORE = 0.51
#: Anything but letters, and a word that repeats the one before it, says nothing about the language.
OTHER = re.compile(r"[\W\d_]+")
AGAIN = re.compile(r"\b(\w+)(?: \1\b)+")


@dataclass
class Dictionaries:
    languages: list[str]
    shards: list[list[bytes]]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn_from: Column | None = None) -> Dictionaries:
    """Dictionaries from ``docs(doc_id, text, lang)``; rows without language, or without a letter, teach nothing."""
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang",
        (F.lit(True) if learn_from is None else learn_from).alias("learn"),
    ).where("learn and lang is not null").where(has_letter(F.col("text")))
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return Dictionaries([], [])
    # twice as many rows as wanted, by a hash of the id, then the first ones in the order of another hash
    shares = [
        (r["lang"], min(1.0, 2 * DOCS_PER_LANGUAGE / r["count"]), DOCS_PER_LANGUAGE * CHARS_PER_DOC // min(r["count"], DOCS_PER_LANGUAGE))
        for r in counts
    ]
    share = docs.sparkSession.createDataFrame(shares, "lang string, share double, chars int")
    middle = F.greatest((F.length("text") - F.col("chars")) / 2, F.lit(0)).cast("int")
    drawn = (
        rows.join(F.broadcast(share), "lang")  # a row a language
        .where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(""))), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
        .select("lang", F.xxhash64(F.lit(1), "doc_id").alias("turn"), F.substring(F.col("text"), middle + 1, F.col("chars")).alias("part"))
        .distinct()
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "part")))
        .where(F.col("nth") <= DOCS_PER_LANGUAGE)
        .collect()
    )
    languages = sorted(lang for lang, *_ in shares)
    shards = []
    for lang in languages:
        parts = [normalised(r["part"]) for r in sorted((r for r in drawn if r["lang"] == lang), key=lambda r: r["nth"])]
        # with few rows every shard gets all of them
        each = [parts[i::SHARDS] for i in range(SHARDS)] if len(parts) >= 4 * SHARDS else [parts[i:] + parts[:i] for i in range(SHARDS)]
        shards.append([b" ".join(x) + b" " * 8 for x in each])
    return Dictionaries(languages, shards)


def normalised(text: str) -> bytes:
    """Lower-case words with one blank between them."""
    return AGAIN.sub(r"\1", OTHER.sub(" ", text.lower())).encode("utf-8", "replace")


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    """Finds matches of three bytes and more, with tables that hold the whole dictionary."""
    how = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=3, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_dict_id=0, write_content_size=0,
    )
    content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


def sizes(text: str, compressors: list[list[zstandard.ZstdCompressor]]) -> np.ndarray:
    """Compressed bytes behind each language's dictionaries."""
    data = normalised(text)
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    return np.array([sum(len(c.compress(x)) for c in shards for x in chunks) for shards in compressors], float)


def _predict(found, at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Dictionaries(**found.value)
        compressors = [[compressor(data) for data in shards] for shards in model.shards]
        for batch in batches:
            names, scores = [], []
            for text, usable in zip(text_of(batch, at), batch.column(2).to_pylist(), strict=True):
                if not usable or not model.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                size = sizes(text.as_py(), compressors)
                best = int(size.argmin())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2((size[best] - size) / BYTES_PER_HALVING).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    return run


def classify(docs: DataFrame, model: Dictionaries, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs``, with ``lang_pred``, ``score`` and ``accepted``.

    The score is 1 over the sum of 2 to the power of (best size - size) /
    ``BYTES_PER_HALVING`` over all languages: 1 for a clear case, 1/2 for two that
    tie.  Ties go to the language that sorts first.  A text that is null or has
    no letter is ``und`` with score 0, and so is any text when nothing was
    learned.  ``accepted`` is false for ``und`` and where the score is below
    ``MIN_SCORE``.  Rows that repeat are classified alike; the columns ``lang`` and
    ``source`` are never looked at.
    """
    found = docs.sparkSession.sparkContext.broadcast(vars(model))
    out, at = carried(docs, carry, has_letter(F.col("text").cast("string")).alias("usable"))
    fields = out.schema["row"].dataType.simpleString()
    return out.mapInArrow(_predict(found, at), f"row {fields}, lang_pred string, score double").select(
        "row.*", "lang_pred", "score", ((F.col("score") >= MIN_SCORE) & (F.col("lang_pred") != UNDETERMINED)).alias("accepted")
    )
