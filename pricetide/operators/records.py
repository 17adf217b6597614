"""Price records that are merged, not computed again: one row per listing and block of 64 runs.

A block holds in which of its runs the listing was seen, as bits, and what its
priced points say: the newest, the lowest and the highest one, how many, since when.  All
of it merges, so the record of a history is that of its parts together, and a
new run only touches rows of its own block.  Everything that is asked of a
whole history is an aggregate over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.tables import LISTING_KEY, POINT_ORDER, PriceTables

#: A block's runs are the bits of one long.
BLOCK_BITS = 6


def block() -> Column:
    return F.shiftright("run_id", BLOCK_BITS).alias("block")


def run_bit() -> Column:
    place = F.col("run_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def runs_in(bits: Column) -> Column:
    """How many runs blocks hold together; NULL bits are none."""
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("long")


def records(points: DataFrame, order: Sequence[str] = POINT_ORDER) -> DataFrame:
    """``(store_id, sku, block, runs, newest, low, high, n_prices, since)`` of a history or any part of it.

    Equal prices keep the earliest date.  A point without a run is in the block NULL.
    """
    price, at = F.col("inr_price"), F.col("captured_at")
    priced = price.isNotNull()
    return points.groupBy(*LISTING_KEY, block()).agg(
        F.bit_or(run_bit()).alias("runs"),
        F.max(F.when(priced, F.struct(*order, price.alias("price")))).alias("newest"),
        F.min(F.when(priced, F.struct(price.alias("price"), at.alias("at")))).alias("low"),
        F.min(F.when(priced, F.struct((-price).alias("price"), at.alias("at")))).alias("high"),
        F.count(price).alias("n_prices"),
        F.min(F.when(priced, at)).alias("since"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The records of several parts of a history, put together.  No point may be in two parts."""
    return parts.groupBy(*LISTING_KEY, "block").agg(
        F.bit_or("runs").alias("runs"),
        F.max("newest").alias("newest"),
        F.min("low").alias("low"),
        F.min("high").alias("high"),
        F.sum("n_prices").alias("n_prices"),
        F.min("since").alias("since"),
    )


def history_stats(record: DataFrame) -> DataFrame:
    """``history.history_stats`` from a record; the history is not read."""
    low, high = F.col("_low"), F.col("_high")
    return (
        record.where("n_prices > 0")
        .groupBy(*LISTING_KEY)
        .agg(
            F.max("newest").alias("_newest"),
            F.min("low").alias("_low"),
            F.min("high").alias("_high"),
            F.sum("n_prices").alias("n_prices"),
            F.min("since").alias("since"),
        )
        .select(
            *LISTING_KEY, F.col("_newest.price").alias("now_price"), low["price"].alias("low_price"), low["at"].alias("low_at"),
            (-high["price"]).alias("high_price"), high["at"].alias("high_at"), "n_prices", "since",
        )
    )


def lows_and_runs(t: PriceTables) -> DataFrame:
    """``(store_id, sku, block, low, runs)``: from the kept record where there is one, else from the history.

    From the history only what is asked for is aggregated; numbers alone, which
    hash aggregation holds in place.
    """
    if t.record is not None:
        return t.record.select(*LISTING_KEY, "block", F.col("low.price").alias("low"), "runs")
    return t.price_point.groupBy(*LISTING_KEY, block()).agg(F.min("inr_price").alias("low"), F.bit_or(run_bit()).alias("runs"))
