"""Feeds, pages, stores and the watchlist file, landed from the given tables.

The payloads are built from every listing and then read by the source
operators; the SQL side computes the expected rows from the listings directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators import audit
from pricetide.plans import text_sql as sql
from pricetide.plans.registry import query
from pricetide.plans.views import DERIVED, VIEWS, Bound
from pricetide.sources import feeds, pages, stores, watchlist
from pricetide.functions.platforms import with_classification

#: What a shop knows about each of its products; 250 products to a feed page.
VIEWS["product"] = """
SELECT store_id, sku, CAST(floor(sku / 250) AS BIGINT) AS page, raw_title, region, condition,
  CASE sku % 4 WHEN 0 THEN 'Nintendo Switch Games' WHEN 1 THEN 'Nintendo Switch 2 Games' WHEN 2 THEN 'Pre-Owned Games' END
    AS product_type,
  CASE WHEN sku % 3 = 0 THEN 'OLED' ELSE 'Action & RPG' END AS tag,
  CASE WHEN sku % 10 = 1 THEN '' WHEN sku % 10 < 4 THEN concat(' S', CAST(sku % 50 AS STRING)) ELSE concat('P', CAST(sku AS STRING)) END
    AS typed_sku,
  CASE WHEN sku % 29 = 0 THEN '' WHEN sku % 28 = 0 THEN 'ask' ELSE concat('Rs. ', CAST(900 + sku % 5000 AS STRING), '.50') END
    AS price_text,
  CASE WHEN sku % 37 = 0 THEN '-500' WHEN sku % 41 = 0 THEN '1.25e3' WHEN sku % 43 = 0 THEN '7' END AS price_json,
  CASE WHEN sku % 37 = 0 THEN -500e0 WHEN sku % 41 = 0 THEN 1250e0 WHEN sku % 43 = 0 THEN 7e0 END AS price_number,
  CAST(90000 + sku % 500000 AS BIGINT) AS minor_price, CASE WHEN sku % 5 = 4 THEN NULL ELSE sku % 4 END AS minor_unit,
  CASE WHEN sku % 6 = 0 THEN FALSE WHEN sku % 6 = 1 THEN NULL ELSE TRUE END AS available, image_url
FROM {listing}"""


#: What names the page of a product: listings dealt by it lie by page before they get their texts.
_PAGE_ID = "concat(CAST(store_id AS STRING), '-', CAST(CAST(floor(sku / 250) AS BIGINT) AS STRING))"

#: What real feeds hold between their products.
JUNK = ['"junk"', "17", "null", '["nested"]', "true"]


def _bodies(rows: DataFrame, item, before: str, after: str) -> DataFrame:
    """One JSON body per store and page: junk, then its products in order of their number."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sku", item.alias("item")))), lambda s: s["item"])
    every = F.concat(F.array(*map(F.lit, JUNK)), listed)
    body = F.concat(F.lit(before + "["), F.array_join(every, ","), F.lit("]" + after))
    return rows.groupBy("store_id", "page").agg(body.alias("body"))


def _with_number(json, field: str, number):
    """The JSON of an item with a text field turned into a number where there is one."""
    return F.when(number.isNotNull(), F.regexp_replace(json, F.lit(f'"{field}":"[^"]*"'), F.concat(F.lit(f'"{field}":'), number))).otherwise(json)


def _shopify_payloads(b: Bound) -> DataFrame:
    variant = F.struct(
        F.col("typed_sku").alias("sku"), F.col("price_text").alias("price"), F.col("available"), F.lit(7).alias("id")
    )
    other = F.struct(F.lit("zz").alias("sku"), F.lit("1").alias("price"), F.lit(True).alias("available"), F.lit(8).alias("id"))
    item = F.struct(
        F.col("sku").alias("id"),
        F.col("raw_title").alias("title"),
        F.concat(F.lit("h-"), "sku").alias("handle"),
        "product_type",
        F.when(F.expr("sku % 2 = 0"), F.array("tag", F.lit("sale"))).alias("tags"),
        F.when(F.expr("sku % 31 <> 0"), F.array(variant, other)).otherwise(F.array().cast("array<struct<sku:string,price:string,available:boolean,id:int>>")).alias("variants"),
        F.when(F.col("image_url").isNotNull(), F.array(F.struct(F.col("image_url").alias("src")))).alias("images"),
    )
    priced = F.regexp_replace(F.to_json(item), '"price":"1"', '"price":1')  # the other variant's is always a number
    return _bodies(b.product, _with_number(priced, "price", F.col("price_json")), '{"products":', "}")


_SHOPIFY_CONTEXT = """concat(raw_title, ' ', COALESCE(product_type, ''), ' ', CASE WHEN sku % 2 = 0 THEN concat(tag, ' sale') ELSE '' END)"""
DERIVED["shopify_seen"] = sql.classify(
    f"""(SELECT p.store_id, p.page, p.sku AS id, p.raw_title, p.image_url, {_SHOPIFY_CONTEXT} AS context, s.platform_hint AS hint,
  s.currency, s.base_url, CASE WHEN p.sku % 31 <> 0 THEN COALESCE(p.price_json, p.price_text) END AS raw_price,
  CASE WHEN p.sku % 31 <> 0 THEN COALESCE(p.price_number, {sql.parse_price('p.price_text')}) END AS native_price,
  COALESCE(p.available, TRUE) AS in_stock,
  COALESCE(NULLIF(trim(CASE WHEN p.sku % 31 <> 0 THEN p.typed_sku END), ''), CAST(p.sku AS STRING)) AS sku
  FROM {{product}} p JOIN {{store}} s ON p.store_id = s.store_id) t""",
    "context", "hint", "raw_title",
)
_ONE_PER_SKU = """
WITH kept AS (SELECT * FROM {seen} WHERE native_price IS NOT NULL AND kind = 'GAME' AND platform <> 'UNKNOWN'),
own AS (SELECT k.* REPLACE (CASE WHEN n > 1 THEN CAST(k.id AS STRING) ELSE k.sku END AS sku) FROM kept k JOIN (
  SELECT store_id, sku, COUNT(DISTINCT id) AS n FROM kept GROUP BY store_id, sku) c ON k.store_id = c.store_id AND k.sku = c.sku),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY page, id) AS nth FROM own) f WHERE nth = 1)
SELECT store_id, sku, URL AS url, raw_title AS title, CURRENCY AS native_currency, native_price, in_stock, platform,
  REGION AS region, CONDITION AS condition, image_url FROM first"""


def _listings_sql(seen: str, url: str, currency: str) -> str:
    return (
        _ONE_PER_SKU.replace("{seen}", f"{{{seen}}}")
        .replace("URL AS", f"{url} AS")
        .replace("CURRENCY AS", f"{currency} AS")
        .replace("REGION AS", sql.infer_region("raw_title", "'IN'") + " AS")
        .replace("CONDITION AS", sql.infer_condition("context") + " AS")
    )


@query("src_shopify_feed", _listings_sql("shopify_seen", "concat(base_url, '/products/h-', CAST(id AS STRING))", "currency"))
def src_shopify_feed(b):
    return feeds.shopify_listings(_shopify_payloads(b), b.store)


def _rejected_sql(seen: str) -> str:
    return f"""
SELECT store_id, CASE WHEN COALESCE(raw_price, '') = '' THEN 'no price' ELSE concat(kind, ' / ', platform) END AS reason, COUNT(*) AS n
FROM {{{seen}}} WHERE NOT COALESCE(native_price IS NOT NULL AND kind = 'GAME' AND platform <> 'UNKNOWN', FALSE) GROUP BY 1, 2"""


@query("rejected_rows", _rejected_sql("shopify_seen"))
def rejected_rows(b):
    return audit.rejected_rows(feeds.shopify_products(_shopify_payloads(b), b.store))


def _woo_payloads(b: Bound) -> DataFrame:
    encoded = F.replace(F.replace("raw_title", F.lit("–"), F.lit("&#8211;")), F.lit("é"), F.lit("&eacute;"))
    item = F.struct(
        F.col("sku").alias("id"),
        encoded.alias("name"),
        F.col("typed_sku").alias("sku"),
        F.concat(F.lit("https://woo.example/p/"), "sku").alias("permalink"),
        F.col("available").alias("is_in_stock"),
        F.array(
            F.struct(F.col("product_type").alias("name")),
            F.struct(F.replace("tag", F.lit("&"), F.lit("&amp;")).alias("name")),
        ).alias("categories"),
        F.when(F.col("image_url").isNotNull(), F.array(F.struct(F.col("image_url").alias("src")))).alias("images"),
        F.struct(
            F.when(F.expr("sku % 31 <> 0"), F.col("minor_price").cast("string")).alias("price"),
            F.when(F.expr("sku % 7 = 0"), "AUD").alias("currency_code"),
            F.col("minor_unit").cast("int").alias("currency_minor_unit"),
        ).alias("prices"),
    )
    unit_as_text = F.regexp_replace(F.to_json(item), r'"currency_minor_unit":(\d)', '"currency_minor_unit":"$1"')
    return _bodies(b.product, F.when(F.expr("sku % 47 = 0"), unit_as_text).otherwise(F.to_json(item)), "", "")


DERIVED["woo_seen"] = sql.classify(
    """(SELECT p.store_id, p.page, p.sku AS id, p.raw_title, p.image_url, concat(p.raw_title, ' ', COALESCE(p.product_type, ''), ' ', p.tag)
  AS context, s.platform_hint AS hint, CASE WHEN p.sku % 7 = 0 THEN 'AUD' ELSE s.currency END AS currency,
  CASE WHEN p.sku % 31 <> 0 THEN CAST(p.minor_price AS STRING) END AS raw_price,
  CASE WHEN p.sku % 31 <> 0 THEN CAST(p.minor_price AS DOUBLE) / power(10e0, CASE WHEN p.sku % 47 = 0 THEN 2 ELSE COALESCE(p.minor_unit, 2) END) END AS native_price,
  COALESCE(p.available, TRUE) AS in_stock, COALESCE(NULLIF(trim(p.typed_sku), ''), CAST(p.sku AS STRING)) AS sku
  FROM {product} p JOIN {store} s ON p.store_id = s.store_id) t""",
    "context", "hint", "raw_title",
)


@query("src_woo_feed", _listings_sql("woo_seen", "concat('https://woo.example/p/', CAST(id AS STRING))", "currency"))
def src_woo_feed(b):
    return feeds.woo_listings(_woo_payloads(b), b.store)


_CODE = "CASE sku % 5 WHEN 0 THEN ' nsw2' WHEN 1 THEN 'PS5' ELSE 'NSW' END"
_CATEGORY = "CASE WHEN sku % 7 = 0 THEN 'Toys' ELSE ' GAMES' END"
_BOXED = "CASE WHEN sku % 3 = 0 THEN 'Open Boxed' ELSE 'sealed' END"
_STOCK_TEXT = "CASE sku % 4 WHEN 0 THEN 'SOLD OUT' WHEN 1 THEN 'Currently out of stock' ELSE 'In stock' END"
_QUANTITY = "CASE WHEN sku % 6 = 2 THEN 0e0 WHEN sku % 6 = 3 THEN 4e0 END"
#: A quantity given as text says nothing.
_COUNTED = f"CASE WHEN sku % 47 <> 0 THEN {_QUANTITY} END"


def _custom_payloads(b: Bound) -> DataFrame:
    item = F.struct(
        F.concat("sku", F.lit("")).alias("id"),
        F.concat(F.lit("  "), "raw_title").alias("name"),
        F.expr(_CODE).alias("platform"),
        F.expr(_CATEGORY).alias("category"),
        F.lit("Shop").alias("navItem"),
        F.expr(_BOXED).alias("tag"),
        F.col("price_text").alias("price"),
        F.expr("sku % 17 = 0").alias("isInquiryOnly"),
        F.expr(_STOCK_TEXT).alias("availability"),
        F.expr(_QUANTITY).alias("stockQuantity"),
        F.col("image_url").alias("imgUrl"),
        F.lit("https://cdn.example/x.png").alias("img"),
    )
    as_text = F.regexp_replace(F.to_json(item), r'"stockQuantity":([0-9.]+)', '"stockQuantity":"$1"')
    json = F.when(F.expr("sku % 47 = 0"), as_text).otherwise(F.to_json(item))
    return _bodies(b.product, _with_number(json, "price", F.col("price_json")), '{"success":true,"data":', "}")


DERIVED["custom_seen"] = sql.classify(
    f"""(SELECT p.*, s.currency, s.base_url, COALESCE(p.price_number, {sql.parse_price('p.price_text')}) AS native_price,
  concat('  ', raw_title, ' ', {_CATEGORY}, ' Shop  ', {_CODE}, ' ', {_BOXED}) AS context
  FROM {{product}} p JOIN {{store}} s ON p.store_id = s.store_id WHERE sku % 7 <> 0 AND sku % 5 <> 1) t""",
    "context", "NULL", "raw_title",
)


@query("src_custom_feed", f"""
SELECT store_id, CAST(sku AS STRING) AS sku, concat(base_url, '/product/', regexp_replace(left(regexp_replace(regexp_replace(
    lower(raw_title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 100), '-+$', ''), '-', CAST(sku AS STRING)) AS url,
  raw_title AS title, currency AS native_currency, native_price,
  sku % 4 NOT IN (0, 1) AND COALESCE({_COUNTED} > 0, TRUE) AS in_stock, CASE WHEN sku % 5 = 0 THEN 'SWITCH2' ELSE 'SWITCH' END AS platform,
  {sql.infer_region('raw_title', "'IN'")} AS region,
  {sql.infer_condition(f"concat(raw_title, ' ', CASE WHEN sku % 3 = 0 THEN 'Open Box' ELSE 'sealed' END)")} AS condition,
  CASE WHEN image_url IS NULL THEN 'https://cdn.example/x.png' ELSE concat(base_url, image_url) END AS image_url
FROM {{custom_seen}} WHERE kind = 'GAME' AND native_price > 0 AND sku % 17 <> 0""")
def src_custom_feed(b):
    return feeds.custom_listings(_custom_payloads(b), b.store)


@query("rejected_elements", """
SELECT store_id, page, CAST(position AS INTEGER) AS position, 'no object' AS reason
FROM (SELECT DISTINCT store_id, page FROM {product}) p, (SELECT unnest(range(5)) AS position) j
UNION ALL SELECT store_id, -7, NULL, CASE store_id % 3 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'refused' ELSE 'no product list' END FROM {store}""")
def rejected_elements(b):
    """The junk of each page, and one page per shop that is no feed at all."""
    bad = F.when(F.expr("store_id % 3 = 0"), "{oops").when(F.expr("store_id % 3 = 1"), '{"success":false,"data":[]}').otherwise('{"success":true}')
    broken = b.store.select("store_id", F.lit(-7).cast("bigint").alias("page"), bad.alias("body"))
    return feeds.rejected_elements(_custom_payloads(b).unionByName(broken), feeds.CUSTOM)


# ---- pages: JSON-LD on every third, hydration state on every third, cards on all ----------------

VIEWS["page_product"] = """
SELECT store_id, page, concat(CAST(store_id AS STRING), '-', CAST(page AS STRING)) AS page_id, sku, raw_title,
  900 + sku % 5000 AS price, sku % 6 = 0 AS gone, CASE WHEN sku % 8 = 0 THEN concat('/blog/about-', CAST(sku AS STRING))
    WHEN sku % 3 = 0 THEN concat('https://shop', CAST(store_id AS STRING), '.example/p?id=', CAST(sku AS STRING), '&utm=1')
    ELSE concat('/product/thing-', CAST(sku AS STRING), '?id=&ref=2') END AS href
FROM {product}"""


def _pages(b: Bound) -> DataFrame:
    """Landed HTML: the given pages as they are, and one page per feed page."""
    product = F.struct(
        F.when(F.expr("sku % 2 = 0"), "Product").otherwise("IndividualProduct").alias("@type"),
        F.col("raw_title").alias("name"),
        F.col("href").alias("url"),
        F.array(
            F.struct(
                F.when(F.expr("sku % 13 <> 0"), F.concat(F.lit("₹"), "price")).alias("price"),
                F.when(F.expr("sku % 13 = 0"), F.col("price").cast("string")).alias("lowPrice"),
                F.when(F.col("gone"), "https://schema.org/Out Of Stock").otherwise("InStock").alias("availability"),
            )
        ).alias("offers"),
    )
    state = F.struct(
        F.col("raw_title").alias("title"),
        F.struct(F.col("price").alias("value")).alias("price"),
        F.col("href").alias("baseUrl"),
        F.struct(F.when(F.col("gone"), "OUT_OF_STOCK").otherwise("BUY").alias("intent")).alias("availability"),
    )
    script = F.when(F.expr("page % 3 = 0"), F.when(F.expr("store_id % 2 = 0"), F.to_json(product)).otherwise(
        F.to_json(F.struct(product.alias("item"))))).when(F.expr("page % 3 = 1"), F.to_json(state))
    listed = F.array_sort(F.collect_list(F.when(F.expr("page % 3 <= 1"), F.struct("sku", script.alias("item")))))
    built = b.page_product.groupBy("page_id", "store_id", "page").agg(
        F.array_join(F.transform(listed, lambda s: s["item"]), ",").alias("listed")
    )
    html = F.concat(F.lit("<html><head>"), _scripts(), F.lit("</head><body>shop</body></html>"))
    given = b.pages.select(
        F.concat(F.lit("web-"), "page_id").alias("page_id"), F.lit(-1).cast("bigint").alias("store_id"), "html"
    )
    return built.select("page_id", "store_id", html.alias("html")).unionByName(given)


def _scripts():
    """Script blocks of a page from the JSON of its products."""
    opening = '<script type="application/ld+json">{broken</script><script id="x" type="application/ld+json" data-y="1">'
    graph = F.concat(F.lit('{"@graph":['), "listed", F.lit("]}"))
    items = F.concat(F.lit('{"@type":"ItemList","itemListElement":['), "listed", F.lit("]}"))
    linked = F.concat(F.lit(opening), F.when(F.expr("store_id % 2 = 0"), graph).otherwise(items), F.lit("</script>"))
    state = F.concat(F.lit('{"pageData":{"widgets":[['), "listed", F.lit("]]}}"))
    hydration = F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), state, F.lit(";</script>"))
    return F.when(F.expr("page % 3 = 0"), linked).when(F.expr("page % 3 = 1"), hydration).otherwise("")


def _cards(b: Bound) -> DataFrame:
    cut = F.concat(F.left("raw_title", F.lit(10)), F.lit("..."))
    return b.page_product.select(
        "page_id",
        "store_id",
        F.col("sku").cast("int").alias("position"),
        F.when(F.expr("sku % 9 = 0"), cut).otherwise(F.col("raw_title")).alias("title"),
        F.array(F.lit("tooltip"), "raw_title").alias("titles"),
        F.when(F.expr("sku % 2 = 0"), F.col("price").cast("string")).otherwise("").alias("price_text"),
        F.concat(F.lit("Renewed offer Rs. "), "price", F.lit(" only")).alias("card_text"),
        "href",
        F.col("gone").alias("out_of_stock"),
    )


_FOUND = ["page_id", "store_id", "title", "price", "href", "in_stock"]
_FOUND_SQL = "page_id, store_id, raw_title AS title, CAST(price AS DOUBLE) AS price, href, NOT gone AS in_stock"


@query("src_jsonld_products", f"SELECT {_FOUND_SQL} FROM {{page_product}} WHERE page % 3 = 0")
def src_jsonld_products(b):
    return pages.jsonld_products(_pages(b)).select(*_FOUND)


@query("rejected_blocks", """
SELECT DISTINCT page_id, store_id, 'json-ld' AS layer, CAST(0 AS INTEGER) AS block, 'malformed' AS reason, '{{broken' AS start
FROM {page_product} WHERE page % 3 = 0""".replace("{{", "{"))
def rejected_blocks(b):
    """The broken block beside each page's products."""
    return pages.rejected_blocks(_pages(b))


@query("src_embedded_state", f"SELECT {_FOUND_SQL} FROM {{page_product}} WHERE page % 3 = 1")
def src_embedded_state(b):
    return pages.embedded_state(_pages(b)).select(*_FOUND)


DERIVED["card_row"] = r"""
SELECT page_id, store_id, page, sku, CASE WHEN sku % 9 = 0 AND length(raw_title) > length(trim(left(raw_title, 10)))
    THEN raw_title WHEN sku % 9 = 0 THEN concat(left(raw_title, 10), '...') ELSE raw_title END AS title,
  CAST(price AS DOUBLE) AS price, href, NOT gone AS in_stock, concat('Renewed offer Rs. ', CAST(price AS STRING), ' only') AS context
FROM {page_product}"""
DERIVED["winner"] = """
SELECT page_id, store_id, sku, 'json-ld' AS layer, raw_title AS title, CAST(price AS DOUBLE) AS price, href, NOT gone AS in_stock,
  '' AS context FROM {page_product} WHERE page % 3 = 0
UNION ALL SELECT page_id, store_id, sku, 'embedded-state', raw_title, CAST(price AS DOUBLE), href, NOT gone, ''
  FROM {page_product} WHERE page % 3 = 1
UNION ALL SELECT page_id, store_id, sku, 'selectors', title, price, href, in_stock, context FROM {card_row}
  WHERE page % 3 NOT IN (0, 1)"""


@query("layered_extract", "SELECT page_id, store_id, layer, title, price, href, in_stock, context FROM {winner}")
def layered_extract(b):
    paged = b.dealt(_PAGE_ID)
    won = pages.layered_extract(_pages(paged), _cards(paged))
    return won.select("page_id", "store_id", "layer", "title", "price", "href", "in_stock", "context")


DERIVED["profiled_winner"] = """
SELECT page_id, store_id, 'json-ld' AS layer, raw_title AS title, CAST(price AS DOUBLE) AS price
  FROM {page_product} WHERE page % 3 = 0 AND store_id % 4 <> 1
UNION ALL SELECT page_id, store_id, 'embedded-state', raw_title, CAST(price AS DOUBLE)
  FROM {page_product} WHERE page % 3 = 1 AND store_id % 2 = 0
UNION ALL SELECT page_id, store_id, 'selectors', title, price FROM {card_row}
  WHERE NOT (page % 3 = 0 AND store_id % 4 <> 1) AND NOT (page % 3 = 1 AND store_id % 2 = 0)"""


@query("layered_extract_profiled", "SELECT page_id, store_id, layer, title, price FROM {profiled_winner}")
def layered_extract_profiled(b):
    said = b.store.select(
        "store_id", F.when(F.expr("store_id % 4 IN (1, 2)"), F.expr("store_id % 4 = 1")).alias("skip_json_ld"),
        F.expr("store_id % 2 = 0").alias("reads_state"),
    )
    paged = b.dealt(_PAGE_ID)
    return pages.layered_extract(_pages(paged), _cards(paged), said).select("page_id", "store_id", "layer", "title", "price")


@query("extraction_funnel", "WITH game AS (" + sql.classify("(SELECT * FROM {winner}) t", "title", "NULL") + """)
SELECT p.page_id, CASE WHEN page % 3 = 0 THEN n ELSE 0 END AS json_ld_rows, CASE WHEN page % 3 = 1 THEN n ELSE 0 END AS state_rows,
  n AS card_rows, CASE WHEN page % 3 = 0 THEN 'json-ld' WHEN page % 3 = 1 THEN 'embedded-state' ELSE 'selectors' END AS winner,
  COALESCE(k.kept, 0) AS kept, FALSE AS short_circuit
FROM (SELECT page_id, page, COUNT(*) AS n FROM {page_product} GROUP BY 1, 2) p LEFT JOIN (
  SELECT page_id, COUNT(*) AS kept FROM game WHERE kind = 'GAME' AND platform <> 'UNKNOWN' GROUP BY 1) k ON p.page_id = k.page_id""")
def extraction_funnel(b):
    paged = b.dealt(_PAGE_ID)
    rows = with_classification(pages.all_layers(_pages(paged), _cards(paged)), F.col("title"))
    return audit.extraction_funnel(
        rows.withColumn("is_game", (F.col("kind") == "GAME") & (F.col("platform") != "UNKNOWN"))
    )


#: How each shop's pages are read.
VIEWS["profile"] = """
SELECT store_id, store_id % 2 = 0 AS require_digit, CASE WHEN store_id % 3 = 0 THEN 'JP' ELSE 'IN' END AS default_region,
  store_id % 4 = 0 AS sku_includes_region, CASE WHEN store_id % 5 = 0 THEN 'PRE_OWNED' END AS default_condition,
  store_id % 2 = 1 AS condition_from_context, platform_hint FROM {store}"""
DERIVED["page_listing"] = "WITH game AS (" + sql.classify(
    """(SELECT w.*, f.require_digit, f.default_region, f.sku_includes_region, f.default_condition, f.condition_from_context,
  f.platform_hint, s.base_url, s.currency FROM {winner} w JOIN {profile} f ON w.store_id = f.store_id
  JOIN {store} s ON s.store_id = w.store_id) t""", "title", "platform_hint",
) + f"""),
placed AS (SELECT *, {sql.infer_region('title', 'default_region')} AS region,
  CASE WHEN starts_with(href, 'http') THEN href ELSE concat(base_url, href) END AS link FROM game
  WHERE kind = 'GAME' AND platform <> 'UNKNOWN' AND NOT contains(href, '/blog/'))
SELECT page_id, store_id,
  concat(CASE WHEN contains(link, '?id=&') THEN concat('thing-', CAST(sku AS STRING)) ELSE CAST(sku AS STRING) END,
    CASE WHEN sku_includes_region THEN concat('-', lower(region)) ELSE '' END) AS sku,
  CASE WHEN contains(link, '?id=&') THEN split_part(link, '?', 1) ELSE split_part(link, '&', 1) END AS url, title,
  currency AS native_currency, price AS native_price, in_stock, platform, region,
  COALESCE(default_condition, CASE WHEN condition_from_context AND context <> '' THEN {sql.infer_condition('context')}
    ELSE {sql.infer_condition('title')} END) AS condition FROM placed"""  # fmt: skip


@query("page_rows_to_listings", "SELECT * FROM {page_listing}")
def page_rows_to_listings(b):
    profiles = b.profile.withColumns({"id_params": F.array(F.lit("id")), "reject_parts": F.array(F.lit("/blog/"))})
    paged = b.dealt(_PAGE_ID)
    rows = pages.layered_extract(_pages(paged), _cards(paged))
    return pages.page_listings(rows, b.store, profiles).drop("position")


# ---- stores ------------------------------------------------------------------

VIEWS["correction"] = """
SELECT s_suppkey * 2 AS store_id, CASE s_suppkey % 3 WHEN 0 THEN 'JSON_API' WHEN 1 THEN 'BROWSER' END AS kind,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 4 = 1 END AS enabled,
  CASE WHEN s_suppkey % 5 = 0 THEN 'checked by hand' END AS note FROM {supplier}"""


@query("dim_store_effective", """
SELECT s.store_id, s.name, CASE WHEN c.kind IN ('SHOPIFY', 'WOOCOMMERCE', 'BROWSER', 'HOBBYALL') THEN c.kind ELSE s.kind END AS kind,
  COALESCE(c.enabled, s.enabled) AS enabled, COALESCE(c.note, s.note) AS note
FROM {store} s LEFT JOIN {correction} c ON s.store_id = c.store_id""")
def dim_store_effective(b):
    return stores.effective_stores(b.store, b.correction).select("store_id", "name", "kind", "enabled", "note")


@query("select_stores", """
SELECT 'enabled' AS picked, store_id, name FROM {store} WHERE enabled
UNION ALL SELECT 'named', store_id, name FROM {store} WHERE store_id IN (SELECT store_id FROM {correction})
UNION ALL SELECT 'nothing named', store_id, name FROM {store} WHERE enabled""")
def select_stores(b):
    enabled = stores.select_stores(b.store).select(F.lit("enabled").alias("picked"), "store_id", "name")
    named = stores.select_stores(b.store, b.correction).select(F.lit("named").alias("picked"), "store_id", "name")
    nothing = stores.select_stores(b.store, b.correction.where("store_id < 0"))
    return enabled.unionByName(named).unionByName(nothing.select(F.lit("nothing named").alias("picked"), "store_id", "name"))


@query("select_stores_missing", """
SELECT DISTINCT store_id FROM {correction} WHERE store_id NOT IN (SELECT store_id FROM {store})""")
def select_stores_missing(b):
    return stores.missing_stores(b.store, b.correction)


# ---- the watchlist file --------------------------------------------------------

VIEWS["watch_entry"] = """
SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN '"nonsense"' ELSE concat('{{"platform":',
  CASE WHEN p_partkey % 23 = 0 THEN '7' ELSE '"SWITCH"' END, ',"game":"', p_name, ' ', CAST(p_partkey AS STRING), '"',
  CASE p_partkey % 8 WHEN 0 THEN concat(',"target":', CAST(p_partkey + 1 AS STRING)) WHEN 1 THEN ',"target":"4000"'
    WHEN 2 THEN ',"target":true' WHEN 3 THEN ',"target":-5' WHEN 4 THEN ',"target":12.5' WHEN 5 THEN ',"target":null'
    WHEN 6 THEN ',"target":0' ELSE '' END,
  CASE p_partkey % 3 WHEN 0 THEN ',"condition":"NEW"' WHEN 1 THEN ',"condition":"USED"' ELSE '' END,
  CASE p_partkey % 5 WHEN 0 THEN ',"shops":"INDIA"' WHEN 1 THEN ',"shops":3' ELSE '' END, '}}') END AS entry
FROM {part}""".replace("{{", "' || chr(123) || '").replace("}}", "' || chr(125) || '")


@query("src_watchlist", """
SELECT concat(p_name, ' ', CAST(p_partkey AS STRING)) AS game, 'SWITCH' AS platform,
  CASE p_partkey % 8 WHEN 0 THEN CAST(p_partkey + 1 AS DOUBLE) WHEN 4 THEN 12.5e0 END AS target,
  CASE WHEN p_partkey % 3 = 0 THEN 'NEW' ELSE 'ANY' END AS condition, CASE WHEN p_partkey % 5 = 0 THEN 'INDIA' ELSE 'ALL' END AS shops
FROM {part} WHERE p_partkey % 31 <> 0 AND p_partkey % 23 <> 0""")
def src_watchlist(b):
    """One file per 250 entries, a broken one and one that is no list."""
    entries = F.array_sort(F.collect_list(F.struct("p_partkey", "entry")))
    body = F.concat(F.lit("["), F.array_join(F.transform(entries, lambda e: e["entry"]), ","), F.lit("]"))
    files = b.watch_entry.groupBy(F.floor(F.col("p_partkey") / 250)).agg(body.alias("body")).select("body")
    broken = files.limit(1).select(F.explode(F.array(F.lit("[not json"), F.lit('{"game":"x","platform":"SWITCH"}'))).alias("body"))
    return watchlist.read_watchlist(files.unionByName(broken)).drop("position")


VIEWS["watch_change"] = """
SELECT CASE WHEN p_partkey % 4 = 3 THEN concat('brand new ', p_name) ELSE concat(p_name, ' ', CAST(p_partkey % 40 AS STRING)) END AS game,
  CASE WHEN p_partkey % 3 = 0 THEN 'SWITCH2' ELSE 'SWITCH' END AS platform, p_partkey AS ord, p_partkey % 5 < 2 AS set_target,
  CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END AS target, CASE WHEN p_partkey % 7 = 0 THEN 'NEW' END AS condition,
  CASE WHEN p_partkey % 6 = 0 THEN 'INDIA' WHEN p_partkey % 6 = 1 THEN 'ALL' END AS shops
FROM {part} WHERE p_size > 10"""


@query("watchlist_upsert", """
WITH change AS (
  SELECT game, platform, bool_or(set_target) AS sets, arg_max(struct_pack(t := target), ord) FILTER (WHERE set_target) AS target,
    arg_max(condition, ord) FILTER (WHERE condition IS NOT NULL) AS condition,
    arg_max(shops, ord) FILTER (WHERE shops IS NOT NULL) AS shops FROM {watch_change} GROUP BY game, platform),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game, platform ORDER BY position) AS nth FROM {watchlist}) w WHERE nth = 1)
SELECT w.game, w.platform, w.target, w.condition, w.shops FROM {watchlist} w
WHERE NOT EXISTS (SELECT 1 FROM change c WHERE c.game = w.game AND c.platform = w.platform)
UNION ALL
SELECT c.game, c.platform, CASE WHEN c.sets THEN c.target.t ELSE n.target END, COALESCE(c.condition, n.condition, 'ANY'),
  COALESCE(c.shops, n.shops, 'ALL') FROM change c LEFT JOIN now n ON c.game = n.game AND c.platform = n.platform""")
def watchlist_upsert(b):
    return watchlist.watchlist_upsert(b.watchlist, b.watch_change)


@query("watchlist_remove", """
SELECT game, platform, target FROM {watchlist} w
WHERE NOT EXISTS (SELECT 1 FROM {watch_change} c WHERE c.game = w.game AND c.platform = w.platform)""")
def watchlist_remove(b):
    return watchlist.watchlist_remove(b.watchlist, b.watch_change).select("game", "platform", "target")
