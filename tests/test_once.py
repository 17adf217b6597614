"""Costly steps stand once in a plan: bodies are parsed once, text is classified once, script blocks are read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions.platforms import with_classification
from pricetide.operators.matching import keyed_titles
from pricetide.sources import feeds, pages


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _feed(spark):
    payloads = spark.createDataFrame([(1, 0, "{}")], "store_id long, page long, body string")
    stores = spark.createDataFrame([(1, "https://a.example", "INR", None)], "store_id long, base_url string, currency string, platform_hint string")
    return payloads, stores


def test_bodies_are_parsed_once(spark):
    payloads, stores = _feed(spark)
    assert optimized(feeds.rejected_elements(payloads, feeds.CUSTOM)).count("parseJson(") == 1
    for products in (feeds.shopify_products, feeds.woo_products, feeds.custom_products):
        assert optimized(products(payloads, stores).where("kept")).count("parseJson(") == 1


def test_text_is_classified_once_under_a_filter(spark):
    df = spark.range(1).select(F.concat(F.lit("Zelda Switch "), "id").alias("title"))
    once = optimized(with_classification(df, F.col("title")))
    filtered = optimized(with_classification(df, F.col("title")).where("kind = 'GAME' AND platform <> 'UNKNOWN'"))
    assert filtered.count("RLIKE") == once.count("RLIKE")


def test_scripts_are_read_once_and_cards_of_won_pages_not_at_all(spark):
    html = '<script type="application/ld+json">{"@type":"Product","name":"A","url":"/a","offers":{"price":5}}</script>'
    landed = spark.createDataFrame([("p", 1, html), ("q", 1, "")], "page_id string, store_id long, html string")
    cards = spark.createDataFrame(
        [(i, 1, 0, "B", ["B"], "7", "", "/b", False) for i in ("p", "q", None)],
        "page_id string, store_id long, position int, title string, titles array<string>, price_text string, card_text string, href string, out_of_stock boolean",
    )
    won = pages.layered_extract(landed, cards)
    assert "InMemoryRelation" in optimized(won)
    assert sorted((r.page_id, r.layer, r.price) for r in won.collect()) == [("p", "json-ld", 5.0), ("q", "selectors", 7.0)]


def test_fields_that_read_like_another_type(spark):
    body = '{"products":[{"id":"[1]","title":["no"],"handle":"{h}","variants":[{"price":"5","available":"false","sku":{"a":1}}]}]}'
    payloads, stores = _feed(spark)
    row = feeds.shopify_products(payloads.withColumn("body", F.lit(body)), stores).first()
    assert (row.title, row.product_id, row.sku, row.url, row.in_stock) == ("", "[1]", "[1]", "https://a.example/products/{h}", True)


def test_keys_are_made_once_under_a_filter(spark):
    titles = spark.range(1).select(F.concat(F.lit("Zelda Switch "), "id").alias("raw_title"), F.lit("SWITCH").alias("platform"))
    keyed = keyed_titles(titles)
    assert optimized(keyed.where("key <> '' AND platform <> 'UNKNOWN'")).count("edition") == optimized(keyed).count("edition") > 0
