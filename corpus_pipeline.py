"""From raw documents to packed training sequences: five stages, each a table of its own.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept,
and returns the columns of ``documents``; the last returns packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import langid, neardup, packing, pii, quality
from pricetide.llm.common import in_fold, keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 3, 1))
    return quality.classify(docs, model, COLUMNS).where("predicted = 1").select(COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` becomes the language found."""
    model = langid.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    found = langid.classify(docs, model, COLUMNS).where("accepted")
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id."""
    return neardup.one_of_each(docs, COLUMNS)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` counts the new text."""
    found = pii.find(docs.select(COLUMNS), pii.fit(docs))
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("found")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most ``packing.CAPACITY`` code points; none holds a source, or copies of a text, twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", personal_data_masked),
    ("packing", packed),
]

#: The stages train classifiers, so SQL cannot express them; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
