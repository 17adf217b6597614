"""Price moves since the previous observation, and which of them are the currency's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.functions.prices import fixed_text
from pricetide.operators.history import latest_and_previous, raw_change
from pricetide.session import hold
from pricetide.tables import LISTING_KEY, PriceTables


def moves(points: DataFrame) -> DataFrame:
    """The latest point of every listing whose price really changed, with ``pct``."""
    before = F.col("previous.inr_price")
    return (
        latest_and_previous(points)
        .where((F.col("inr_price") != before) & (before > 0))
        .withColumn("pct", raw_change())
        .where(F.abs("pct") > vocab.MIN_CHANGE_PCT)
        .withColumn("pct_bucket", fixed_text(F.col("pct"), 1))
    )


def fx_clusters(moved: DataFrame) -> DataFrame:
    """How many listings of a currency moved by the same tenth of a percent."""
    return (
        moved.groupBy("native_currency", "pct_bucket")
        .agg(F.count(F.lit(1)).alias("cluster_size"))
        .withColumn(
            "fx_suspect",
            (F.col("cluster_size") >= vocab.FX_CLUSTER_THRESHOLD)
            & (F.col("native_currency") != vocab.HOME_CURRENCY),
        )
    )


def movers(t: PriceTables, store_id: object = None) -> DataFrame:
    """All real price moves; ``is_deal`` leaves out currency moves.

    Cluster sizes are aggregated and joined back: a window over a currency's
    moves would put the whole currency into one task.  The moves are needed
    for the clusters and for the rows, so they are held rather than ranked
    twice.  Reports the raw stock flag of the latest point.  In no order;
    ``movers_page`` has one.
    """
    moved = hold(moves(t.recent).withColumn("prev_price", F.col("previous.inr_price")).drop("previous"))
    suspects = fx_clusters(moved).where("fx_suspect").select("native_currency", "pct_bucket", "fx_suspect")
    listing = t.listing.select(*LISTING_KEY, "raw_title", "url", "region")
    shop = t.store.select("store_id", F.col("name").alias("store"))
    rows = (
        moved.join(suspects, ["native_currency", "pct_bucket"], "left")
        .join(listing, LISTING_KEY)
        .join(shop, "store_id")
        .withColumn("fx_suspect", F.coalesce("fx_suspect", F.lit(False)))
    )
    if store_id is not None:
        rows = rows.where(F.col("store_id") == store_id)
    return rows.select(
        *LISTING_KEY,
        "raw_title",
        "url",
        "region",
        "store",
        F.col("native_currency").alias("currency"),
        F.col("inr_price").alias("now_price"),
        "prev_price",
        "in_stock",
        "captured_at",
        "pct",
        "fx_suspect",
        ((F.col("pct") < 0) & ~F.col("fx_suspect")).alias("is_deal"),
    )


def movers_page(t: PriceTables, limit: int, offset: int = 0, store_id: object = None) -> DataFrame:
    """One page of moves, biggest drop first."""
    return movers(t, store_id).orderBy("pct", *LISTING_KEY).offset(offset).limit(limit)


def mover_stores(t: PriceTables) -> DataFrame:
    """The stores that have moves, by name."""
    moved = moves(t.recent).select("store_id").distinct()
    return t.store.join(moved, "store_id", "left_semi").select(F.col("name").alias("store")).distinct().orderBy("store")
