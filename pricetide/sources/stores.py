"""The store dimension and which stores a run covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import vocab


def effective_stores(shipped: DataFrame, corrections: DataFrame) -> DataFrame:
    """Shipped stores with corrections (store_id, kind, enabled, note) applied.

    An unknown kind falls back to the shipped one; corrections for stores that
    do not exist are ignored.
    """
    patch = corrections.select(
        "store_id",
        F.when(F.col("kind").isin(*vocab.STORE_KINDS), F.col("kind")).alias("_kind"),
        F.col("enabled").alias("_enabled"),
        F.col("note").alias("_note"),
    )
    return (
        shipped.join(patch, "store_id", "left")
        .withColumn("kind", F.coalesce("_kind", "kind"))
        .withColumn("enabled", F.coalesce("_enabled", "enabled"))
        .withColumn("note", F.coalesce("_note", "note"))
        .drop("_kind", "_enabled", "_note")
    )


def select_stores(stores: DataFrame, only: DataFrame | Sequence | None = None) -> DataFrame:
    """The stores of a run: exactly the named ones, enabled or not; all enabled ones when none is named."""
    if only is None or (not isinstance(only, DataFrame) and not only):
        return stores.where("enabled")
    if not isinstance(only, DataFrame):
        return stores.where(F.col("store_id").isin(*only))
    named = only.select("store_id").distinct()
    # whether anything is named is a value of its own, known when the plan runs
    return stores.sparkSession.sql(
        """
        SELECT s.* FROM {stores} s LEFT JOIN {named} n ON n.store_id = s.store_id
        WHERE CASE WHEN (SELECT COUNT(*) FROM {only}) > 0 THEN n.store_id IS NOT NULL ELSE s.enabled END""",
        stores=stores, named=named, only=only,
    )


def missing_stores(stores: DataFrame, only: DataFrame) -> DataFrame:
    """Named stores nobody knows."""
    return only.select("store_id").distinct().join(stores, "store_id", "left_anti")
