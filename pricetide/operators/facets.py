"""Filter options with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.operators.common import count_where
from pricetide.operators.listings import ListingQuery, filter_terms, priced_listings
from pricetide.tables import PriceTables

FACETS = {"stores": "store_id", "platforms": "platform", "regions": "region", "conditions": "condition"}
#: Facets that take several values at once, so their own filter must not narrow them.
MULTI_VALUED = ("stores", "regions")


def _exploded(listing: DataFrame, flags: dict[str, object]) -> DataFrame:
    """Each listing once per facet, so that all facets come from one aggregation."""
    return listing.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("facet"),
                        F.col(column).cast("string").alias("value"),
                        flags.get(name, F.lit(True)).alias("counted"),
                    )
                    for name, column in FACETS.items()
                ]
            )
        ).alias("f")
    ).select("f.*")


def _named(counts: DataFrame, t: PriceTables) -> DataFrame:
    """With ``label``, what a value is called: a store by its name, others by themselves."""
    names = t.store.select(F.col("store_id").cast("string").alias("value"), F.lit("stores").alias("facet"), F.col("name").alias("label"))
    return counts.join(names, ["facet", "value"], "left").select(
        "facet", "value", F.coalesce("label", "value").alias("label"), "n"
    )


def facet_order() -> list[Column]:
    """Stores by name, the values of other facets by count."""
    store = F.col("facet") == "stores"
    return [F.asc("facet"), F.when(store, F.col("label")), F.desc(F.when(~store, F.col("n"))), F.asc("value")]


def facets(t: PriceTables) -> DataFrame:
    """Listings per store, platform, region and condition, priced or not."""
    return _named(_exploded(t.listing, {}).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")), t)


def facet_left_join(t: PriceTables) -> DataFrame:
    """Listings with their latest point, keeping unpriced ones."""
    return priced_listings(t, how="left")


def facets_self_excluding(t: PriceTables, query: ListingQuery) -> DataFrame:
    """Counts under every active filter but the facet's own.

    A value nothing matches stays listed with 0.  Platforms and conditions are
    single-choice, so they count all listings.
    """
    terms = filter_terms(query)

    def others(own: str):
        out = F.lit(True)
        for name, term in terms.items():
            if name != own:
                out = out & F.coalesce(term, F.lit(False))
        return out

    flags = {name: others(name) for name in MULTI_VALUED}
    needs_price = query.in_stock_only
    if needs_price:
        source = facet_left_join(t)
    else:
        source = t.listing.join(t.store.select("store_id", "ships_from_abroad"), "store_id")
    return _named(_exploded(source, flags).groupBy("facet", "value").agg(count_where(F.col("counted")).alias("n")), t)
