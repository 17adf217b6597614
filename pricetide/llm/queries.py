"""The operators applied to the given tables: one query per operator, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import alignment, ann, bpe, langid, licenses, neardup, packing, pii, quality, simhash, sql, topk, urlfilter, whitening
from pricetide.llm.common import in_fold, keep, table

#: The rules that ``op6_url_filters`` applies: host, beginning of the path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    scored = quality.classify(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """A document's place in the collection is its path: source, language, id."""
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    found = licenses.inherited(licenses.scan(docs, ["doc_id", "path"]))
    return found.select("doc_id", "path", "license", "origin", "similarity", "from_folder")


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    kinds = F.col("found.kind")
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode(table(spark, folder, "documents"), vocabulary, ["doc_id"])
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    counted = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    back = bpe.decode(counted, vocabulary, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, folder, "pages"), rules)


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), k=4)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    found = langid.classify(docs, langid.fit(docs, ~held_out), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates form a cluster, and so do equal texts that have no word."""
    text = F.col("text").cast("string")
    found = neardup.groups(table(spark, folder, "documents"), "doc_id", "source", F.length(text).alias("length"), F.xxhash64(text).alias("same"))
    cluster = F.when(F.col("n_shingles") > 0, F.col("component_id")).when(F.col("length") > 0, F.col("same"))
    measured = keep(found.select("doc_id", "source", "length", cluster.alias("cluster")))
    return packing.pack_documents(measured, cluster="cluster", length="length")


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = alignment.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    aligned = alignment.align(table(spark, folder, "documents"), vocabulary, ["doc_id"])
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    counted = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return alignment.with_counts(aligned.select(*counted, digest, "pairs"), vocabulary, [*counted, "groups_sha256"])


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_license_scans, op3_nearest_neighbours, op4_personal_data, op5_bpe_round_trip,
        op6_url_filters, op7_minhash_near_dedup, op8_language_id, op9_best_fit_packing, op10_exact_top_k,
        op11_cross_tokenizer_alignment, op12_embedding_whitening, op13_simhash_near_dedup,
    )
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {"op6_url_filters": sql.url_filters(RULES), "op10_exact_top_k": sql.top_k(50, 5)}
