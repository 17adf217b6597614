"""The filtered, sorted listing view."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pricetide.functions.titles import literal_contains
from pricetide.operators.history import latest_and_previous, real_move, with_buyable, with_change
from pricetide.operators.paging import SortKey, page
from pricetide.tables import LISTING_KEY, PriceTables

SORTS = {
    "price": "inr_price",
    "title": "raw_title",
    "store": "store",
    "seen": "captured_at",
    "change": "change_pct",
}


@dataclass(frozen=True)
class ListingQuery:
    """One set of filters for listings, games and facets; empty means no filter."""

    q: str = ""
    platform: str = ""
    condition: str = ""
    stores: tuple = ()
    regions: tuple = ()
    in_stock_only: bool = False
    game: str | Column = ""
    domestic_only: bool = False
    sort: str = "price"
    direction: str = "asc"
    limit: int = 100
    offset: int = 0
    #: The cursor of the last row of the page before, in place of an offset.
    after: tuple | None = None

    @property
    def sort_column(self) -> str:
        return SORTS.get(self.sort, SORTS["price"])

    @property
    def descending(self) -> bool:
        return self.direction.lower() == "desc"

    @property
    def page(self) -> tuple[int, int]:
        """(limit, offset) as asked for; at least one row, from the first one on."""
        return max(1, self.limit), max(0, self.offset)


def filter_terms(query: ListingQuery) -> dict[str, Column]:
    """The active filters by name, over columns of ``priced_listings``."""
    terms: dict[str, Column] = {}
    if query.q:
        terms["q"] = literal_contains(F.col("raw_title"), query.q)
    if query.platform:
        terms["platform"] = F.col("platform") == query.platform
    if query.condition:
        terms["condition"] = F.col("condition") == query.condition
    if query.stores:
        terms["stores"] = F.col("store_id").isin(*query.stores)
    if query.regions:
        terms["regions"] = F.col("region").isin(*query.regions)
    if query.in_stock_only:
        terms["in_stock_only"] = F.col("buyable")
    if isinstance(query.game, Column) or query.game:
        terms["game"] = F.col("game") == query.game
    if query.domestic_only:
        terms["domestic_only"] = ~F.col("ships_from_abroad")
    return terms


def listing_filter(query: ListingQuery) -> Column:
    out = F.lit(True)
    for term in filter_terms(query).values():
        out = out & term
    return out


def latest_join(listing: DataFrame, points: DataFrame) -> DataFrame:
    """Listings with their latest point; unpriced listings drop out."""
    return listing.join(latest_and_previous(points), LISTING_KEY)


def previous_join(listing: DataFrame, points: DataFrame) -> DataFrame:
    """Priced listings with the latest and, where there is one, the previous price."""
    return latest_join(listing, points).select(
        *LISTING_KEY, "raw_title", "inr_price", F.col("previous.inr_price").alias("previous_price")
    )


def listing_store_join(listing: DataFrame, store: DataFrame) -> DataFrame:
    """Listings with their shop's name, currency and origin."""
    shop = store.select("store_id", F.col("name").alias("store"), "currency", "ships_from_abroad")
    return listing.join(shop, "store_id")


def listing_game_join(listing: DataFrame, games: DataFrame, keep_ungrouped: bool = False) -> DataFrame:
    """Listings of known products; with ``keep_ungrouped`` all of them."""
    how = "left" if keep_ungrouped else "inner"
    known = games.select("game", "platform", F.lit(True).alias("_known")).distinct()
    joined = listing.join(known, ["game", "platform"], how)
    return joined.withColumn("game", F.when(F.col("_known"), F.col("game"))).drop("_known")


def domestic_only(listing: DataFrame, store: DataFrame) -> DataFrame:
    """Listings of shops that do not ship from abroad."""
    return listing.join(store.where("ships_from_abroad").select("store_id"), "store_id", "left_anti")


def game_semi_join(listing: DataFrame, games: DataFrame) -> DataFrame:
    """Listings grouped under one of the given products, on any platform."""
    return listing.join(games.select("game"), "game", "left_semi")


def priced_listings(t: PriceTables, how: str = "inner") -> DataFrame:
    """Listings with shop, latest and previous point, ``buyable`` and ``change_pct``.

    ``how="left"`` keeps unpriced listings, which are then not buyable.  What is known of shops comes last: listings and
    points have met by then, so where shops are too many to be broadcast, rows are dealt by shop once for all of it.
    """
    latest = with_change(latest_and_previous(t.recent))
    shop = t.store.select("store_id", F.col("name").alias("store"), "ships_from_abroad")
    described, priced = ([c for c in df.columns if c not in LISTING_KEY] for df in (t.listing, latest.drop("change_pct")))
    return (
        with_buyable(t.listing.join(latest, LISTING_KEY, how).join(shop, "store_id"), t.run_store)
        .select(*LISTING_KEY, *described, "store", "ships_from_abroad", *priced, "buyable", "change_pct")
    )


def matching_listings(t: PriceTables, query: ListingQuery) -> DataFrame:
    """Every listing a query selects, before paging.

    Sorting by change is a view of real movers, so it filters too, before any
    count or limit.
    """
    df = priced_listings(narrowed(t, query)).where(listing_filter(query))
    return df.where(real_move()) if query.sort == "change" else df


def narrowed(t: PriceTables, query: ListingQuery) -> PriceTables:
    """The tables without listings that the query's filters on listings and shops rule out, and without their points.

    What needs no price is decided before the history is ranked.
    """
    terms = {name: term for name, term in filter_terms(query).items() if name not in ("in_stock_only", "domestic_only")}
    if not terms and not query.domestic_only:
        return t
    listing = reduce(DataFrame.where, terms.values(), t.listing)
    if query.domestic_only:
        listing = domestic_only(listing, t.store)
    points = t.recent.join(listing.select(*LISTING_KEY), LISTING_KEY, "left_semi")
    return t.with_(listing=listing, latest=points)


def listings_total(t: PriceTables, query: ListingQuery) -> DataFrame:
    return matching_listings(t, query).agg(F.count(F.lit(1)).alias("total"))


def listings_order(query: ListingQuery) -> list[SortKey]:
    """The order of a query's listings; all keys are columns of a page, so its last row is the next page's cursor."""
    nulls_first = not query.descending and query.sort != "change"
    chosen = SortKey(F.col(query.sort_column), query.descending, nulls_first)
    return [chosen, *[SortKey(F.col(k)) for k in LISTING_KEY]]


def listings_cursor(query: ListingQuery, row: Row) -> tuple:
    """Where the page after the one that ends with ``row`` goes on."""
    return (row[query.sort_column], *[row[k] for k in LISTING_KEY])


def listings_page(t: PriceTables, query: ListingQuery = ListingQuery()) -> DataFrame:
    """One page of listings in the requested order; after a cursor, or after an offset.

    Which listings are on it is found by keys and sort keys; all else is then read of those only, which are few
    enough to know before anything runs.
    """
    limit, offset = query.page
    order = listings_order(query)
    keys = page(matching_listings(t, query), order, limit + offset, 0, query.after).select(*LISTING_KEY).distinct()
    listing, points = t.listing.join(keys, LISTING_KEY), t.recent.join(keys, LISTING_KEY, "left_semi")
    columns = (
        *LISTING_KEY, "raw_title", "url", "region", "platform", "condition", "store", "inr_price",
        "native_price", "native_currency", F.col("buyable").alias("in_stock"), "captured_at", "change_pct",
    )
    few = t.with_(listing=listing, latest=points)
    return page(matching_listings(few, query), order, limit, offset, query.after).select(*columns)


def game_offers(t: PriceTables, game: str | Column, platform: str, query: ListingQuery = ListingQuery()) -> DataFrame:
    """A page of the offers behind one product row, cheapest first; limit and offset are the query's.

    ``game`` may be a scalar subquery: then nothing runs to find it before the page does.
    """
    return listings_page(t, replace(query, game=game, platform=platform, sort="price", direction="asc"))
