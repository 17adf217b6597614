"""Quality and language: held-out accuracy and odd input."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import langid, quality, queries
from pricetide.llm.common import in_fold, table

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
ODD = [(1, None, "en", 1), (2, "", "de", 2), (3, " \n\t ", None, 3), (4, "a", "en", 4), (4, "a", "en", 4), (None, "the word", "en", 5), (6, "é" * 200_000, "fr", 6), (7, "123 !?", "fr", 7)]
ODD_SCHEMA = "doc_id long, text string, lang string, row long"


@needs_tables
def test_quality_on_rows_it_has_not_seen(spark):
    scored = queries.op1_quality_classifier(spark, FOLDER)
    marked = scored.join(table(spark, FOLDER, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in marked])
    assert len(marked) > 50 and right >= 0.95
    assert scored.count() == table(spark, FOLDER, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored.collect())


def test_quality_of_odd_rows_without_labels(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    got = quality.classify(docs, model, ["doc_id", "row"]).collect()
    assert [r["score"] for r in got] == [0.5] * len(ODD) and {r["row"] for r in got} == {r[3] for r in ODD}
    empty = docs.limit(0)
    assert quality.classify(empty, quality.fit(empty, none), ["doc_id"]).collect() == []


def test_labels_may_be_odd(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (4, 1), (7, None), (9, 1), (6, 5)], "doc_id long, quality int")
    got = quality.classify(docs, quality.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)


def test_pooled_vectors_follow_their_definition():
    vectors = np.random.default_rng(1).normal(size=(quality.VOCABULARY, quality.DIMS)).astype(np.float32)
    texts = ["ab cd ab", None, "x", "Heat Heat Heat!!"]
    got = quality.features(texts, vectors)
    for text, row in zip(texts, got, strict=True):
        _, hashed = quality.tokens([(text or "").encode()])
        want = np.zeros(2 * quality.DIMS)
        at, sign = quality.random_entries(hashed)
        full = np.zeros((len(hashed), quality.DIMS))
        for i in range(len(hashed)):
            for j in range(quality.NONZEROS):
                full[i, at[i, j]] += sign[i, j]
            want[: quality.DIMS] += vectors[int(hashed[i]) & (quality.VOCABULARY - 1)] / len(hashed)
        if len(hashed):
            want[quality.DIMS :] = (full[:-1] * full[1:]).sum(axis=0) / len(hashed)
        assert np.allclose(row, want, atol=1e-5)


@needs_tables
def test_language_on_rows_it_has_not_seen(spark):
    found = queries.op8_language_id(spark, FOLDER)
    known = found.join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(known) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in known]) >= 0.95


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD + [(8, "the word and the other word", "en", 8)] * 3, ODD_SCHEMA)
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r["row"]: r for r in langid.classify(docs, model, ["doc_id", "row"]).collect()}
    assert all(got[i]["lang_pred"] == langid.UNDETERMINED and got[i]["score"] == 0 and not got[i]["accepted"] for i in (1, 2, 3, 7))
    assert got[6]["lang_pred"] in ("en", "fr") and got[8]["lang_pred"] == "en" and got[8]["accepted"]
    empty = docs.limit(0)
    nothing = langid.fit(empty)
    assert nothing.languages == [] and langid.classify(empty, nothing, ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in langid.classify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_learned_and_few_long_texts_teach_all_they_hold(spark):
    many = [(i, f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}{chr(0x4E02 + 3 * i)} " * 5, f"l{i:03}") for i in range(300)]
    long = " ".join(f"palabra{i} {'abcdefgh'[i % 8] * (i % 5 + 1)}" for i in range(20_000))
    docs = spark.createDataFrame([*many, (900, long, "es")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 301
    held = model.shards[model.languages.index("es")][0]
    assert len(held) > 150_000  # not six hundred characters of the one text there is
    got = {r["doc_id"]: r["lang_pred"] for r in langid.classify(docs.where("doc_id in (0, 150, 299)"), model, ["doc_id"]).collect()}
    assert got == {0: "l000", 150: "l150", 299: "l299"}


def test_predictions_are_the_smallest_sizes(spark):
    """Text by text: compressed behind each dictionary, added up, the smallest wins, the first of equals."""
    import zstandard

    docs = spark.createDataFrame(
        [(i, " ".join(["the cat sat on", "le chat sur la", "die katze auf der"][i % 3].split()[: i % 4 + 1] * (i % 7 + 1)), "x") for i in range(40)],
        "doc_id long, text string, source string",
    )
    model = langid.fit(docs.withColumn("lang", F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("doc_id") % 3 + 1).cast("int"))))
    how = zstandard.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_checksum=0, write_dict_id=0, write_content_size=0,
    )
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.classify(docs, model, ["doc_id"]).collect():
        data, total = langid.normalised(texts[r["doc_id"]]), []
        for shards in model.shards:
            dicts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in shards]
            total.append(sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(data)) for d in dicts))
        assert r["lang_pred"] == model.languages[total.index(min(total))]
        assert r["score"] == pytest.approx(1 / sum(2 ** ((min(total) - t) / langid.BYTES_PER_HALVING) for t in total))


def test_rows_held_out_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "hola mundo" if i % 2 else "hello world", "es" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    assert langid.fit(docs, F.col("doc_id") % 2 == 0).languages == ["en"]


def test_narrow_margins_are_rejected(spark):
    model = langid.Dictionaries(["a", "b"], [[b"same text here        "] * langid.SHARDS] * 2)
    docs = spark.createDataFrame([(1, "something else")], "doc_id long, text string")
    row = langid.classify(docs, model, ["doc_id"]).first()
    assert row["lang_pred"] == "a" and row["score"] == 0.5 and not row["accepted"]


def test_fold_is_a_hash_of_the_id_as_text(spark):
    import zlib

    got = spark.range(50).select("id", in_fold(F.col("id"), 3, 1).alias("f")).collect()
    assert all(r["f"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
