"""Operators over the append-only observation history.

One ranked pass serves every "latest", "previous" and "change" question.  Only
the two newest points of a listing survive the map side, so the exchange
carries listings, not history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.prices import change_pct, shown_change
from pricetide.operators.common import newest, top_rows
from pricetide.tables import LISTING_KEY, POINT_ORDER


def nth_latest(points: DataFrame, n: int = 1, order: Sequence[str] = POINT_ORDER) -> DataFrame:
    """The n-th newest point of each listing that has one (1 = latest)."""
    return top_rows(points, LISTING_KEY, newest(order), n).where(F.col("rn") == n).drop("rn")


def two_newest(points: DataFrame, order: Sequence[str] = POINT_ORDER) -> DataFrame:
    """The state that reads of today's prices need: the two newest points of each listing, as they are."""
    return top_rows(points, LISTING_KEY, newest(order), 2).drop("rn")


def latest_and_previous(points: DataFrame, order: Sequence[str] = POINT_ORDER) -> DataFrame:
    """The latest point of each listing with the one before it in ``previous`` (NULL if none)."""
    rest = [c for c in points.columns if c not in LISTING_KEY]
    window = Window.partitionBy(*LISTING_KEY).orderBy(*newest(order))
    return (
        top_rows(points, LISTING_KEY, newest(order), 2)
        .withColumn("previous", F.lead(F.struct(*rest)).over(window))
        .where(F.col("rn") == 1)
        .drop("rn")
    )


def last_ok_run(run_store: DataFrame) -> DataFrame:
    """The newest fully successful run of each store."""
    return run_store.where(F.col("status") == "ok").groupBy("store_id").agg(F.max("run_id").alias("ok_run"))


def with_buyable(latest: DataFrame, run_store: DataFrame) -> DataFrame:
    """Add ``buyable``: in stock, and no fully successful run of the store came later.

    A partial or failed run may have missed a listing that is still for sale,
    so it does not count.
    """
    still_listed = F.col("run_id") >= F.coalesce("ok_run", F.lit(0))
    return (
        latest.join(last_ok_run(run_store), "store_id", "left")
        .withColumn("buyable", F.coalesce(F.col("in_stock") & still_listed, F.lit(False)))
        .drop("ok_run")
    )


def with_change(latest: DataFrame) -> DataFrame:
    """Add ``change_pct`` from the previous point; NULL where too small to show."""
    return latest.withColumn("change_pct", shown_change(F.col("inr_price"), F.col("previous.inr_price")))


def real_move() -> Column:
    """The price moved by more than the threshold since the previous point."""
    now, before = F.col("inr_price"), F.col("previous.inr_price")
    return (before != 0) & (now != before) & shown_change(now, before).isNotNull()


def raw_change() -> Column:
    return change_pct(F.col("inr_price"), F.col("previous.inr_price"))


def price_history(
    points: DataFrame, store_id: object = None, sku: object = None, order: Sequence[str] = POINT_ORDER
) -> DataFrame:
    """One listing's price series, oldest first; every listing's, in no order, when none is named."""
    columns = ["captured_at", "inr_price", "native_price", "native_currency", "in_stock", "fx_rate_date"]
    if store_id is None:
        return points.select(*LISTING_KEY, *columns)
    chosen = points.where((F.col("store_id") == store_id) & (F.col("sku") == sku))
    return chosen.orderBy(*order).select(*columns)


def history_stats(points: DataFrame, order: Sequence[str] = POINT_ORDER) -> DataFrame:
    """Now, lowest and highest price with their dates, number of priced points, since when.

    Equal prices keep the earliest date.  Partial aggregates per listing; no
    series is gathered.
    """
    price, at = F.col("inr_price"), F.col("captured_at")
    position = F.struct(*order)
    stats = points.where(price.isNotNull()).groupBy(*LISTING_KEY)
    low, high = F.col("_low"), F.col("_high")
    return stats.agg(
        F.max_by(price, position).alias("now_price"),
        F.min(F.struct(price.alias("p"), at.alias("d"))).alias("_low"),
        F.min(F.struct((-price).alias("p"), at.alias("d"))).alias("_high"),
        F.count(F.lit(1)).alias("n_prices"),
        F.min(at).alias("since"),
    ).select(
        *LISTING_KEY,
        "now_price",
        low["p"].alias("low_price"),
        low["d"].alias("low_at"),
        (-high["p"]).alias("high_price"),
        high["d"].alias("high_at"),
        "n_prices",
        "since",
    )


def price_series_scaled(points: DataFrame) -> DataFrame:
    """Every priced point with time and price scaled to 0..1 within its listing.

    The extremes come from a partial aggregate joined back, so that a listing
    with a long history never has to pass through one task.
    """
    priced = points.where(F.col("inr_price").isNotNull()).withColumn(
        "t", F.unix_micros(F.col("captured_at").cast("timestamp")).cast("double")
    )
    extent = priced.groupBy(*LISTING_KEY).agg(
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.min("inr_price").alias("lo"),
        F.max("inr_price").alias("hi"),
    )

    def scaled(value: str, low: str, high: str) -> Column:
        span = F.col(high) - F.col(low)
        return (F.col(value) - F.col(low)) / F.when(span == 0, 1.0).otherwise(span)

    return priced.join(extent, LISTING_KEY).select(
        *LISTING_KEY,
        "captured_at",
        "inr_price",
        scaled("t", "t0", "t1").alias("x"),
        scaled("inr_price", "lo", "hi").alias("y"),
    )
