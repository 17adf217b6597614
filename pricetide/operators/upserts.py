"""State kept as derived tables, and appends to the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.functions.prices import fx_convert
from pricetide.functions.urls import is_web_url
from pricetide.operators.common import count_where, last_write
from pricetide.operators.fx import fx_asof
from pricetide.tables import LISTING_KEY

CURRENT = ["url", "raw_title", "platform", "region", "condition"]


def web_url_only(observations: DataFrame) -> DataFrame:
    """Observations whose link may be shown."""
    return observations.where(is_web_url(F.col("url")))


def dropped_links(observations: DataFrame) -> DataFrame:
    """Per store, how many observations have no http(s) link."""
    dropped = count_where(~is_web_url(F.col("url"))).alias("dropped")
    return observations.groupBy("store_id").agg(dropped).where("dropped > 0")


def listing_upsert(observations: DataFrame, order: list[str]) -> DataFrame:
    """Current listing state: descriptive columns from the newest observation,
    image and first_seen from the first.

    Both ends come from partial aggregates.  The image travels in a struct, so
    that a first observation without one stays without one.
    """
    position = F.struct(*order)
    newest, oldest = F.col("_new"), F.col("_old")
    return (
        observations.groupBy(*LISTING_KEY)
        .agg(
            F.max_by(F.struct(*CURRENT), position).alias("_new"),
            F.min_by(F.struct("image_url"), position).alias("_old"),
            F.min("captured_at").alias("first_seen"),
            F.max("captured_at").alias("last_seen"),
        )
        .select(
            *LISTING_KEY, *[newest[c].alias(c) for c in CURRENT], oldest["image_url"].alias("image_url"),
            "first_seen", "last_seen",
        )
    )


def price_points(observations: DataFrame, rates: DataFrame) -> DataFrame:
    """Observations as history rows: the home-currency price is derived once, with its rate's date."""
    converted = fx_asof(observations, rates)
    return converted.withColumn("inr_price", fx_convert(F.col("native_price"), F.col("rate"))).withColumnRenamed(
        "rate_date", "fx_rate_date"
    )


def append_price_points(points: DataFrame, path: str) -> None:
    """Append whole runs to the history, one folder per run, each exactly once.

    A run's folder is written as a whole: appending a run again, after a job that
    failed or whose end nobody saw, puts the same rows in place of what is there.
    Other runs' folders are not touched.  Rebalancing gathers a run into few
    files and, unlike a plain repartition, splits a run that is too large for one task.
    """
    writer = points.hint("rebalance", F.col("run_id")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def fx_rate_upsert(fetched: DataFrame, order: list[str]) -> DataFrame:
    """One rate per currency pair and publication day, the last fetch winning.

    Home-to-home rates are never kept, nor rows without a rate or a date.
    """
    usable = fetched.where(
        (F.col("base") != vocab.HOME_CURRENCY) & F.col("rate").isNotNull() & F.col("rate_date").isNotNull()
    )
    return last_write(usable, ["base", "quote", "rate_date"], order)
