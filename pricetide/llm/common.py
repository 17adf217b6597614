"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the cluster's shared checkpoint folder, which ``spark.checkpoint.dir`` names, and go on from there.

    What it was computed from is given back at once: Spark deletes shuffle files
    and checkpoints when the driver's garbage collector finds that no plan refers
    to them any more, which a driver with little to do would put off until disks are full.
    """
    spark, out = df.sparkSession, settle(df)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def carried(docs: DataFrame, carry: list[str], *more: Column) -> tuple[DataFrame, int | None]:
    """Rows for Python: a struct ``row`` of what passes through, the text, and ``more``.

    A text that passes through is sent once: the second value is its place in the struct.
    """
    at = carry.index("text") if "text" in carry and docs.schema["text"].dataType.simpleString() == "string" else None
    text = F.col("text").cast("string") if at is None else F.lit(None).cast("string")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), text.alias("text"), *more), at


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row's id, hashed as text, falls in a fold; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
