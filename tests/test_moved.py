"""What queries on offers move between tasks: keys and numbers, once; texts only of what is shown."""

import pytest
from pyspark.sql import functions as F

from pricetide.operators import listings, offers, watch
from pricetide.operators.listings import ListingQuery
from pricetide.plans import source_queries
from pricetide.session import release
from pricetide.tables import LISTING_KEY, PriceTables
from test_growth import _given


def taken(df):
    """Whether a plan takes addresses along."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return "url" in "".join(line for line in text.splitlines() if "LogicalRDD" not in line)


@pytest.fixture
def shop(rows):
    listing = rows(
        [
            (1, 1, "u1", "Game One", "S", "IN", "NEW", "g"),
            (1, 1, "u0", "Other", "S", "IN", "NEW", "h"),  # the same key in another product
            (1, 1, "u3", "Game One again", "S", "JP", "NEW", "g"),
            (2, 1, "u2", "Game One", "S", "JP", "PRE_OWNED", "g"),
            (2, 2, "u4", "Game Two", None, "JP", "NEW", "k"),
            (3, 9, "u5", "Game Three", "S", "IN", "NEW", None),
        ],
        "store_id long, sku long, url string, raw_title string, platform string, region string, condition string, game string",
    )
    store = rows([(1, "One", False), (2, "Two", True), (2, "Too", True), (3, "Three", None)], "store_id long, name string, ships_from_abroad boolean")
    at = F.expr("make_timestamp_ntz(2020, 1, CAST(point_id AS INT), 0, 0, 0)")
    points = rows(
        [(1, 1, 1, 5, 10.0, True), (1, 1, 2, 6, 12.0, True), (2, 1, 3, 6, 9.0, False), (2, 2, 4, 6, None, True), (3, 9, 5, 6, 1.0, True)],
        "store_id long, sku long, point_id long, run_id long, inr_price double, in_stock boolean",
    ).withColumns({"captured_at": at, "native_currency": F.lit("INR"), "native_price": F.col("inr_price"), "fx_rate_date": F.lit(None).cast("date")})
    runs = rows([(6, 1, "ok"), (7, 2, "failed")], "run_id long, store_id long, status string")
    return PriceTables(store=store, listing=listing, price_point=points, run_store=runs)


def test_texts_are_looked_up_for_the_offers_that_won(shop):
    best = offers.games_best_offer(shop)
    got = {(r.game, r.platform): tuple(r)[2:] for r in best.collect()}
    assert got == {
        ("g", "S"): (12.0, True, "u1", "IN", "NEW", "One", 4, 2),
        ("h", "S"): (12.0, True, "u0", "IN", "NEW", "One", 1, 1),
        ("k", None): (None, True, "u4", "JP", "NEW", "Too", 2, 1),
    }
    chosen = offers.best_offers(listings.priced_listings(shop))
    assert not taken(chosen) and taken(best)
    near = offers.games_best_offer(shop, ListingQuery(domestic_only=True, in_stock_only=True)).collect()
    assert sorted(r.game for r in near) == ["g", "h"]


def test_a_page_reads_the_rest_of_its_listings_only(shop):
    """Also where a key has several listings and several shops, after an offset and after a cursor."""
    q = ListingQuery(sort="title", direction="desc", limit=3)
    every = listings.matching_listings(shop, q).orderBy(F.desc("raw_title"), *LISTING_KEY).select("raw_title", *LISTING_KEY).collect()
    assert len(every) == 8
    made = listings.listings_page(shop, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in made and made.count("GlobalLimit") == 3  # the page, the keys of its listings and of their points
    for offset in (0, 2, 7, 9):
        got = listings.listings_page(shop, ListingQuery(sort="title", direction="desc", limit=3, offset=offset))
        assert got.select("raw_title", *LISTING_KEY).collect() == every[offset : offset + 3]
    after = ListingQuery(sort="title", direction="desc", limit=9, after=tuple(every[3]))
    place, keys = every[3], lambda r: (r.store_id, r.sku)
    beyond = [r for r in every if r.raw_title < place.raw_title or (r.raw_title == place.raw_title and keys(r) > keys(place))]
    assert beyond and listings.listings_page(shop, after).select("raw_title", *LISTING_KEY).collect() == beyond


def test_texts_are_looked_up_for_the_watched_offers_that_won(shop, rows):
    release()
    wanted = [("g", "S", 11.0, c, s) for c in ("ANY", "NEW") for s in ("ALL", "INDIA")] + [("h", "S", 12.0, "NEW", "INDIA")]
    t = shop.with_(watchlist=rows(wanted, "game string, platform string, target double, condition string, shops string"))
    assert not taken(watch.best_by_variant(listings.priced_listings(t)))
    got = {(r.game, r.condition, r.shops): (r.best_url, r.best_region, r.best_store, r.best_price, r.offers, r.hit, r.title) for r in watch.watch_status(t, titled=t.listing).collect()}
    one = ("u1", "IN", "One", 12.0)
    assert got == {
        ("g", "ANY", "ALL"): (*one, 4, False, "Game One"), ("g", "ANY", "INDIA"): (*one, 2, False, "Game One"),
        ("g", "NEW", "ALL"): (*one, 2, False, "Game One"), ("g", "NEW", "INDIA"): (*one, 2, False, "Game One"),
        ("h", "NEW", "INDIA"): ("u0", "IN", "One", 12.0, 1, True, "Other"),
    }
    release()


def test_pages_are_put_together_where_their_products_lie(spark, tmp_path):
    tables = _given(spark, tmp_path)
    spark.createDataFrame([(1, "u", "<html/>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    paged = tables.dealt(source_queries._PAGE_ID)
    for view in ("listing", "page_product"):
        assert sorted(map(str, getattr(paged, view).collect())) == sorted(map(str, getattr(tables, view).collect()))
    made, cards = source_queries._pages(paged), source_queries._cards(paged)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(page_id") == 0
    assert cards._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(concat") == 1
    assert sorted(map(str, made.collect())) == sorted(map(str, source_queries._pages(tables).collect()))
