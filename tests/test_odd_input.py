"""Feeds, pages, entities, redirects and walks on input nobody would write on purpose."""

import html
import json
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from conftest import as_dicts
from pricetide import PriceTables
from pricetide.functions.values import html_unescape
from pricetide.operators import dedupe, history, listings, matching, movers
from pricetide.operators.listings import ListingQuery
from pricetide.operators.watch import redirect_resolve
from pricetide.sources import feeds, pages, stores

SHOP = "store_id long, base_url string, currency string, platform_hint string, name string, enabled boolean"


@pytest.fixture
def shop(spark):
    return spark.createDataFrame([(1, "https://s.example", "INR", None, "S", True), (2, "https://t.example", "INR", None, "T", False)], SHOP)


def payload(spark, body):
    return spark.createDataFrame([(1, 0, body if isinstance(body, str) else json.dumps(body))], "store_id long, page long, body string")


def test_junk_beside_a_product_costs_nothing(spark, shop):
    good = {"id": 7, "name": "Zelda Nintendo Switch", "prices": {"price": "449900", "currency_minor_unit": 2}}
    rows = as_dicts(feeds.woo_listings(payload(spark, ["junk", 3, None, [good], good]), shop))
    assert [(r["sku"], r["native_price"]) for r in rows] == [("7", 4499.0)]
    reasons = as_dicts(feeds.rejected_elements(payload(spark, ["junk", 3, None, [good], good]), feeds.WOO))
    assert [(r["position"], r["reason"]) for r in reasons] == [(i, "no object") for i in range(4)]


@pytest.mark.parametrize("body, reason", [("{oops", "no JSON"), ('{"success": "yes", "data": []}', "refused"), ('{"success": true, "data": {}}', "no product list")])
def test_a_page_that_is_no_feed_says_why(spark, shop, body, reason):
    assert [(r["position"], r["reason"]) for r in as_dicts(feeds.rejected_elements(payload(spark, body), feeds.CUSTOM))] == [(None, reason)]
    assert as_dicts(feeds.custom_listings(payload(spark, body), shop)) == []


@pytest.mark.parametrize("price, kept", [(-500, None), ("-500", 500.0), (1.5e3, 1500.0), ("Rs. 1,200", 1200.0), (True, None), ([5], None), (0, None)])
def test_numbers_keep_their_sign(spark, shop, price, kept):
    item = {"id": "9", "name": "Zelda", "platform": "NSW", "category": "Games", "price": price, "stockQuantity": "0"}
    rows = as_dicts(feeds.custom_listings(payload(spark, {"success": True, "data": [item]}), shop))
    assert [r["native_price"] for r in rows] == ([] if kept is None else [kept])
    assert all(r["in_stock"] for r in rows)


def page(spark, text):
    return spark.createDataFrame([("p", 1, text)], "page_id string, store_id long, html string")


def test_blocks_no_parser_survives(spark):
    block = '<script type="application/ld+json">{}</script>'
    good = {"@type": "Product", "name": "A", "url": "/a", "offers": {"price": 10**400, "lowPrice": "5"}}
    text = "".join(block.format(x) for x in ("[" * 100_000, json.dumps(good | {"offers": [{"price": 0, "lowPrice": "7"}]}), json.dumps(good), "{"))
    assert [(r["title"], r["price"]) for r in as_dicts(pages.jsonld_products(page(spark, text)))] == [("A", 7.0)]


def test_state_forty_levels_down_with_script_after_it(spark):
    state = {"title": "T", "price": {"value": 5}, "baseUrl": "/t"}
    for _ in range(40):
        state = {"x": [state]}
    text = f"<script>window.__INITIAL_STATE__ = {json.dumps(state)}; window.b = {{}};</script>"
    assert [(r["title"], r["price"]) for r in as_dicts(pages.embedded_state(page(spark, text)))] == [("T", 5.0)]


def test_every_entity(spark):
    texts = [f"a &{n} b" for n in html5] + [f"&{n}x" for n in html5] + [f"&#{n};" for n in [*range(0x180), 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**30]]
    texts += [f"&#x{n:x}" for n in (0x41, 0x80, 0x1F600, 0x110000)] + ["&", "&&amp;&", "&nosuch;", "&#;", "&#x;", "&#xg", "&notit;", "&amp", "&ampamp;", "1 < 2 &lt 3", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html_unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {t: None if t is None else html.unescape(t) for t in texts}


def test_redirects_far_round_and_nowhere(spark):
    hops = [(f"c{i}", f"c{i + 1}") for i in range(1000)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("t", "s")]
    redirects = spark.createDataFrame([(a, "P", b) for a, b in hops], "old_title string, platform string, new_title string")
    starts = spark.createDataFrame([(k, "P") for k in ("c0", "c990", "c1000", "x", "y", "z", "s", "t", "gone")] + [("c0", "Q")], "key string, platform string")
    got = {(r.key, r.platform): r.resolved for r in redirect_resolve(starts, redirects).collect()}
    assert got == {
        ("c0", "P"): "c1000", ("c990", "P"): "c1000", ("c1000", "P"): "c1000", ("x", "P"): "z", ("y", "P"): "z", ("z", "P"): "y", ("s", "P"): "s",
        ("t", "P"): "s", ("gone", "P"): "gone", ("c0", "Q"): "c0",
    }


def test_a_page_that_failed_does_not_break_a_streak(spark):
    rows = [("w", p, 10, 5, n) for p, n in ((1, 5), (2, 0), (4, 0), (5, 0), (6, 0), (7, 5))]
    df = spark.createDataFrame(rows, "w string, page long, raw_rows long, kept_rows long, new_rows long")
    assert [tuple(r) for r in dedupe.productivity_streak(df, ["w"]).collect()] == [("w", 6, "unproductive")]


def test_nothing_named_means_all_enabled(spark, shop):
    for nothing in (None, [], shop.limit(0)):
        assert [r.store_id for r in stores.select_stores(shop, nothing).collect()] == [1]
    assert [r.store_id for r in stores.select_stores(shop, [2]).collect()] == [2]


def test_long_product_ids_stay_apart(spark):
    from pricetide.functions.urls import sku_from_url

    urls = [f"https://s.example/p/{'x' * 300}{i}" for i in range(2)] + [f"https://s.example/p?id={'y' * 300}{i}" for i in range(2)]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(sku_from_url(F.col("u"), ["id"])).collect()
    assert len({r[0] for r in rows}) == 4


def test_listings_without_a_title_stay(spark):
    listing = spark.createDataFrame([(1, "a", None, "SWITCH"), (1, "b", "Zelda", "SWITCH"), (1, "c", "Zelda", None)], "store_id long, sku string, raw_title string, platform string")
    got = {r.sku: r.game for r in matching.assign_games(listing).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] is None and got["b"] == "zelda"


@pytest.fixture
def priced(spark):
    point = "store_id long, sku long, point_id long, run_id long, captured_at timestamp, native_currency string, native_price double, inr_price double, fx_rate_date date, in_stock boolean"
    rows = [(1, s, s * 10 + r, r, r, "INR", 100.0 + s + r * (s % 3) * 9, r) for s in range(150) for r in range(4)]
    points = spark.createDataFrame([(a, b, c, d, None, f, g, g, None, True) for a, b, c, d, _, f, g, _ in rows], point)
    points = points.withColumn("captured_at", F.timestamp_seconds(F.col("run_id") * 86_400))
    listing = spark.range(150).select(
        F.lit(1).cast("long").alias("store_id"), F.col("id").alias("sku"), F.lit("u").alias("url"), F.concat(F.lit("Zelda "), "id").alias("raw_title"),
        F.lit("SWITCH").alias("platform"), F.lit("IN").alias("region"), F.lit("NEW").alias("condition"), F.lit("zelda").alias("game"),
    )
    store = spark.createDataFrame([(1, "S", False)], "store_id long, name string, ships_from_abroad boolean")
    runs = spark.createDataFrame([(3, 1, "ok")], "run_id long, store_id long, status string")
    return PriceTables(store=store, listing=listing, price_point=points, run_store=runs)


def test_offers_beyond_the_hundredth(priced):
    assert listings.game_offers(priced, "zelda", "SWITCH", ListingQuery(limit=1000)).count() == 150
    assert listings.game_offers(priced, "zelda", "SWITCH", ListingQuery(limit=100, offset=100)).count() == 50


def test_kept_state_says_the_same(priced):
    kept = priced.with_(latest=history.two_newest(priced.price_point))
    for read in (lambda t: listings.listings_page(t, ListingQuery(limit=200)), lambda t: listings.listings_page(t, ListingQuery(sort="change", limit=200)), movers.movers):
        assert sorted(map(tuple, read(kept).collect())) == sorted(map(tuple, read(priced).collect()))


def test_filters_come_before_the_ranking(priced):
    plan = listings.listings_page(priced, ListingQuery(game="zelda", stores=(1,)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_blocks_that_cannot_be_read_are_named(spark):
    """Deep, cut and overlong ones; what was read before the place in question is still a product."""
    block = '<script type="application/ld+json">{}</script>'
    good = json.dumps({"@type": "Product", "name": "A", "url": "/a", "offers": {"price": 5}})
    texts = ["[" * 100_000 + "]" * 100_000, '{"a":' * 100_000, good, "{", "", '{"a": ' + "1" * 5_000 + "}", f"[{good}"]
    state = '<script>window.__INITIAL_STATE__ = {"a":' + "[" * 100_000 + "</script>"
    found = page(spark, "".join(block.format(x) for x in texts) + state)
    got = {(r["layer"], r["block"]): r["reason"] for r in as_dicts(pages.rejected_blocks(found))}
    assert got == {
        ("json-ld", 0): "nested too deep", ("json-ld", 1): "nested too deep", ("json-ld", 3): "malformed",
        ("json-ld", 5): "number too long", ("json-ld", 6): "malformed", ("embedded-state", 0): "nested too deep",
    }
    assert [r["title"] for r in as_dicts(pages.jsonld_products(found))] == ["A"]
    assert as_dicts(pages.rejected_blocks(page(spark, None))) == as_dicts(pages.rejected_blocks(page(spark, "<html>"))) == []
