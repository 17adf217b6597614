"""One row per product: best offer, spread over shops, lowest price on record."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.operators.listings import ListingQuery, listing_filter, narrowed, priced_listings
from pricetide.operators.paging import SortKey, page
from pricetide.operators.records import lows_and_runs, runs_in
from pricetide.tables import GAME_KEY, LISTING_KEY, PriceTables

#: What is shown of a best offer beside its price.
SHOWN = ["url", "region", "condition", "store"]


def best_rank() -> Column:
    """Buyable offers first, then by price; NULL without a price."""
    return F.when(F.col("buyable"), 0.0).otherwise(vocab.OUT_OF_STOCK_RANK) + F.col("inr_price")


def best_struct() -> Column:
    """Ordered so that MIN picks the best offer, by its key; unpriced offers only when all are."""
    rank = best_rank()
    return F.struct(rank.isNull().alias("unpriced"), rank.alias("rank"), *LISTING_KEY, "inr_price", "buyable")


def best_offers(offers: DataFrame) -> DataFrame:
    """Best offer and offer counts of each product among the given priced listings; of the offer its key, price and stock.

    Partial MINs over a struct, not a ranking: first one row per product and
    shop, of numbers only, then one per product.  A shop that has any offer counts as one.
    """
    best = F.col("_best")
    shop = (
        offers.where(F.col("game").isNotNull())
        .groupBy(*GAME_KEY, "store_id")
        .agg(F.min(best_struct()).alias("_best"), F.count(F.lit(1)).alias("offers"))
    )
    return (
        shop.groupBy(*GAME_KEY)
        .agg(F.min("_best").alias("_best"), F.sum("offers").alias("offers"), F.count("store_id").alias("stores"))
        .select(
            *GAME_KEY,
            *[best[k].alias(k) for k in LISTING_KEY],
            best["inr_price"].alias("best_price"),
            best["buyable"].alias("best_in_stock"),
            "offers",
            "stores",
        )
    )


def games_best_offer(t: PriceTables, query: ListingQuery = ListingQuery()) -> DataFrame:
    """Best offers as they are shown.  Texts are looked up for the offers that won, so they take no part in choosing."""
    few = narrowed(t, query)
    best = best_offers(priced_listings(few).where(listing_filter(query)))
    won = ["best_price", "best_in_stock", "offers", "stores"]
    near = ~F.col("ships_from_abroad") if query.domestic_only else F.lit(True)
    shown = with_texts(best, few, GAME_KEY, won, near)
    return shown.select(*GAME_KEY, *won[:2], *[F.col("_text")[c].alias(f"best_{c}") for c in SHOWN], *won[2:])


def with_texts(best: DataFrame, t: PriceTables, keys: list[str], values: list[str], fits: Column) -> DataFrame:
    """``keys``, ``values`` and what is shown of offers that won, in ``_text``.  Offers are given by listing and product.

    A key may have several listings and several shops: the first of those of the product that ``fits`` holds for is shown, as where
    texts take part in choosing.  The product is no key of the join, as listings lie by their own.
    """
    listed = t.listing.where(F.col("game").isNotNull()).withColumnsRenamed({k: f"_{k}" for k in GAME_KEY})
    shop = t.store.select("store_id", F.col("name").alias("store"), "ships_from_abroad")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GAME_KEY], fits)
    text = F.min(F.when(same, F.struct(*SHOWN))).alias("_text")
    return best.join(listed, LISTING_KEY).join(shop, "store_id").groupBy(*keys).agg(text, *[F.any_value(c).alias(c) for c in values])


def display_title(listing: DataFrame) -> DataFrame:
    """The name a product shows: a new copy's title before a used one's, shortest, then A-Z."""
    choice = F.struct(
        (F.col("condition") == "PRE_OWNED").alias("used"),
        F.length("raw_title").alias("length"),
        F.col("raw_title").alias("title"),
    )
    return (
        listing.where(F.col("game").isNotNull())
        .groupBy(*GAME_KEY)
        .agg(F.min(choice)["title"].alias("title"))
    )


def _domestic(t: PriceTables, listing: DataFrame) -> DataFrame:
    abroad = t.store.where("ships_from_abroad").select("store_id")
    return listing.join(abroad, "store_id", "left_anti")


def lowest_ever(t: PriceTables, condition: str = "", domestic: bool = False) -> DataFrame:
    """Lowest price over all stores and runs of each product, and in how many runs it was seen.

    Only condition and origin narrow it.  Runs are bits, 64 to a block: history
    is first reduced to one row per listing and block, or read from the kept
    record, which is that already.
    """
    listing = t.listing.where(F.col("game").isNotNull())
    if condition:
        listing = listing.where(F.col("condition") == condition)
    if domestic:
        listing = _domestic(t, listing)
    return (
        lows_and_runs(t)
        .join(listing.select(*LISTING_KEY, *GAME_KEY), LISTING_KEY)
        .groupBy(*GAME_KEY, "block")
        .agg(F.min("low").alias("low"), F.bit_or("runs").alias("runs"))
        .groupBy(*GAME_KEY)
        .agg(F.min("low").alias("lowest_ever"), runs_in(F.col("runs")).alias("runs_seen"))
    )


def at_lowest() -> Column:
    """At the lowest price on record, which takes at least two runs to mean anything."""
    return F.coalesce(
        (F.col("runs_seen") >= 2) & F.col("best_in_stock") & (F.col("best_price") <= F.col("lowest_ever")),
        F.lit(False),
    )


def price_note() -> tuple[Column, Column]:
    """What to say under a best price, and the lower price of the past where there was one."""
    cheaper_once = F.col("lowest_ever") < F.col("best_price")
    note = F.when(F.col("at_lowest"), "lowest ever").when(cheaper_once, "lower before")
    return note.alias("note"), F.when(~F.col("at_lowest") & cheaper_once, F.col("lowest_ever")).alias("shown")


def games_view(t: PriceTables, query: ListingQuery = ListingQuery(), listing: DataFrame | None = None) -> DataFrame:
    """Every product a query selects, with title, best offer and price record; titles of ``listing``, where the one of ``t`` is dealt for joins."""
    return (
        games_best_offer(t, query)
        .join(display_title(t.listing if listing is None else listing), GAME_KEY, "left")
        .join(lowest_ever(t, query.condition, query.domestic_only), GAME_KEY, "left")
        .withColumn("runs_seen", F.coalesce("runs_seen", F.lit(0)))
        .withColumn("at_lowest", at_lowest())
    )


def games_order(query: ListingQuery) -> list[SortKey]:
    """The order of a query's products; ``paging.cursor_of`` it, beside a page's last row, is the next page's cursor."""
    def toward(column: Column) -> SortKey:
        return SortKey(column, query.descending, not query.descending)

    if query.sort == "title":
        order = [toward(F.lower("title"))]
    elif query.sort == "offers":
        order = [toward(F.col("offers"))]
    else:
        price = F.col("best_price")
        order = [SortKey(price.isNull()), SortKey(F.col("best_in_stock"), True, False), toward(price)]
    return [*order, *[SortKey(F.col(k)) for k in GAME_KEY]]


def games_page(t: PriceTables, query: ListingQuery = ListingQuery(), view: DataFrame | None = None) -> DataFrame:
    """One page of products, after a cursor or after an offset; of ``view``, where a ``games_view`` is at hand.

    By price, products that can be bought come first in both directions and
    unpriced ones last; by title, the displayed one, ignoring case.
    """
    limit, offset = query.page
    return page(games_view(t, query) if view is None else view, games_order(query), limit, offset, query.after)
