"""Scalar expressions over whole tables, and the grouping pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import platforms, prices, titles, urls, values
from pricetide.operators import matching
from pricetide.plans import text_sql as sql
from pricetide.plans.registry import query
from pricetide.plans.views import DERIVED, VIEWS
from pricetide.session import hold

#: Price texts in the spellings shops use, from the numbers of every line item.
VIEWS["price_text"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_orderkey % 9 WHEN 0 THEN concat('Rs. ', CAST(l_extendedprice AS STRING))
    WHEN 1 THEN concat('₹', CAST(floor(l_extendedprice / 1000e0) AS INT), ',', lpad(CAST(l_orderkey % 1000 AS STRING), 3, '0'))
    WHEN 2 THEN concat('INR ', CAST(l_extendedprice AS STRING), ' only')
    WHEN 3 THEN concat(CAST(l_linenumber AS STRING), '.', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ',',
      lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'))
    WHEN 4 THEN 'call us' WHEN 5 THEN concat('MRP Rs. ', CAST(l_partkey AS STRING), '.50, now ₹', CAST(l_suppkey AS STRING))
    WHEN 6 THEN concat('Warriors ', CAST(l_linenumber AS STRING), ' players')
    WHEN 7 THEN concat('1.2.3 ', CAST(l_linenumber AS STRING)) ELSE CAST(l_quantity AS STRING) END AS price_text
FROM {lineitem}"""
_ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ITEMS = _ITEM.split(", ")


@query("parse_price", f"SELECT {_ITEM}, {sql.parse_price('price_text')} AS price FROM {{price_text}}")
def parse_price(b):
    return b.price_text.select(*_ITEMS, prices.parse_price(F.col("price_text")).alias("price"))


@query("first_rupee_price", f"SELECT {_ITEM}, {sql.first_rupee_price('price_text')} AS price FROM {{price_text}}")
def first_rupee_price(b):
    return b.price_text.select(*_ITEMS, prices.first_rupee_price(F.col("price_text")).alias("price"))


@query("minor_units", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(floor(l_extendedprice) AS BIGINT) / power(10e0, COALESCE(CASE WHEN l_orderkey % 5 < 4 THEN l_orderkey % 5 END, 2)) AS price
FROM {lineitem}""")
def minor_units(b):
    unit = F.when(F.expr("l_orderkey % 5 < 4"), F.expr("CAST(l_orderkey % 5 AS INT)"))
    minor = F.floor("l_extendedprice").cast("double")
    return b.lineitem.select(*_ITEMS, prices.minor_units(minor, unit).alias("price"))


#: Distinct listing titles: what the text rules run over.
VIEWS["title"] = "SELECT DISTINCT raw_title, platform FROM {listing}"


@query("named_platform", f"SELECT raw_title, platform, {sql.named_platform('raw_title')} AS named FROM {{title}}")
def named_platform(b):
    return b.title.select("raw_title", "platform", platforms.named_platform(F.col("raw_title")).alias("named"))


@query("platform_of", f"""
SELECT raw_title, platform, COALESCE({sql.named_platform('raw_title')}, platform, 'UNKNOWN') AS read_platform FROM {{title}}""")
def platform_of(b):
    return b.title.select(
        "raw_title", "platform", platforms.platform_of(F.col("raw_title"), F.col("platform")).alias("read_platform")
    )


@query("classify", sql.classify("(SELECT raw_title, platform AS hint FROM {title}) t", "raw_title", "hint"))
def classify(b):
    hinted = b.title.withColumnRenamed("platform", "hint")
    return platforms.with_classification(hinted, F.col("raw_title"), F.col("hint"))


_TAGGED = "concat(raw_title, CASE WHEN platform = 'SWITCH2' THEN ' Switch 2 Games' ELSE ' OLED Games' END)"


@query("classify_with_title", sql.classify(
    f"(SELECT raw_title, platform AS hint, {_TAGGED} AS context FROM {{title}}) t", "context", "NULL", "raw_title"))
def classify_with_title(b):
    tagged = b.title.withColumn("context", F.expr(_TAGGED)).withColumnRenamed("platform", "hint")
    return platforms.with_classification(tagged, F.col("context"), None, F.col("raw_title"))


@query("price_looks_wrong", f"""
SELECT store_id, sku, inr_price, kind, kind = 'GAME' AND (inr_price < 299 OR inr_price > 12000) AS wrong
FROM ({sql.classify('(SELECT store_id, sku, inr_price, raw_title, platform AS hint FROM {offer}) t', 'raw_title', 'hint')}) k""")
def price_looks_wrong(b):
    from pricetide.operators.history import nth_latest

    offers = b.listing.withColumnRenamed("platform", "hint").join(nth_latest(b.price_point), ["store_id", "sku"])
    kinds = platforms.with_classification(offers, F.col("raw_title"), F.col("hint"))
    wrong = prices.price_looks_wrong(F.col("inr_price"), F.col("kind"))
    return kinds.select("store_id", "sku", "inr_price", "kind", wrong.alias("wrong"))


_HOME = "'IN'"


@query("infer_region", f"SELECT raw_title, platform, {sql.infer_region('raw_title', _HOME)} AS region FROM {{title}}")
def infer_region(b):
    return b.title.select("raw_title", "platform", platforms.infer_region(F.col("raw_title"), F.lit("IN")).alias("region"))


@query("infer_condition", f"SELECT raw_title, platform, {sql.infer_condition('raw_title')} AS condition FROM {{title}}")
def infer_condition(b):
    return b.title.select("raw_title", "platform", platforms.infer_condition(F.col("raw_title")).alias("condition"))


VIEWS["card"] = """
SELECT store_id, sku, raw_title AS title, CASE WHEN store_id % 7 = 0 THEN 'PRE_OWNED' END AS asserted,
  store_id % 2 = 0 AS opted_in, CASE WHEN sku % 3 = 0 THEN '' WHEN sku % 3 = 1 THEN 'Renewed stock' ELSE 'In stock' END AS context
FROM {listing}"""


@query("condition_tier", f"""
SELECT store_id, sku, COALESCE(asserted, CASE WHEN opted_in AND context <> '' THEN {sql.infer_condition('context')}
  ELSE {sql.infer_condition('title')} END) AS condition FROM {{card}}""")
def condition_tier(b):
    tier = platforms.condition_tier(F.col("asserted"), F.col("opted_in"), F.col("context"), F.col("title"))
    return b.card.select("store_id", "sku", tier.alias("condition"))


@query("normalise_title", f"SELECT raw_title, platform, {sql.normalise_title('raw_title')} AS clean FROM {{title}}")
def normalise_title(b):
    return b.title.select("raw_title", "platform", titles.normalise_title(F.col("raw_title")).alias("clean"))


@query("fold_accents", f"SELECT doc_id, {sql.fold_accents('text')} AS folded FROM {{documents}}")
def fold_accents(b):
    return b.documents.select("doc_id", titles.fold_accents(F.col("text")).alias("folded"))


@query("match_key", sql.match_keys("(SELECT DISTINCT raw_title FROM {title}) t"))
def match_key(b):
    return titles.with_match_key(b.title.select("raw_title").distinct(), "raw_title", "key")


@query("truncated_title", "SELECT raw_title, platform, raw_title LIKE '%...' OR raw_title LIKE '%…' AS cut FROM {title}")
def truncated_title(b):
    return b.title.select("raw_title", "platform", titles.truncated_title(F.col("raw_title")).alias("cut"))


VIEWS["shown"] = """
SELECT store_id, sku, CASE WHEN sku % 2 = 0 THEN concat(substr(raw_title, 1, 12), '...') WHEN sku % 5 = 0
  THEN concat(substr(raw_title, 1, 9), '…') ELSE raw_title END AS title, raw_title AS full_title,
  concat('tip ', raw_title) AS tip FROM {listing}"""


@query("uncut_title", r"""
SELECT store_id, sku, CASE WHEN (title LIKE '%...' OR title LIKE '%…') AND stem <> '' AND length(full_sq) > length(stem)
  AND starts_with(full_sq, stem) THEN full_sq ELSE title END AS title
FROM (SELECT *, trim(regexp_replace(regexp_replace(title, '(\.\.\.|…)$', ''), '\s+', ' ', 'g')) AS stem,
  trim(regexp_replace(full_title, '\s+', ' ', 'g')) AS full_sq FROM {shown}) s""")
def uncut_title(b):
    uncut = titles.uncut_title(F.col("title"), F.array("tip", "full_title"))
    return b.shown.select("store_id", "sku", uncut.alias("title"))


#: Links of every line item in the shapes shops use.
VIEWS["link"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('https://shop', CAST(l_suppkey AS STRING), '.example/c/list?p=2') AS base,
  CASE l_orderkey % 8 WHEN 0 THEN concat('https://a.example/Some-Title/dp/B0', lpad(CAST(l_partkey AS STRING), 8, '0'), '?ref=1')
    WHEN 1 THEN concat('https://f.example/x/p/itm1?lid=9&pid=PID', CAST(l_partkey AS STRING), '%20A')
    WHEN 2 THEN concat('https://w.example/product-detail?sku=&id=', CAST(l_partkey AS STRING), '&utm_source=z')
    WHEN 3 THEN concat('https://n.example/product/thing-', CAST(l_partkey AS STRING), '/?sid=', CAST(l_orderkey AS STRING))
    WHEN 4 THEN concat('/p/rel ', CAST(l_partkey AS STRING), '#top') WHEN 5 THEN concat('item-', CAST(l_partkey AS STRING))
    WHEN 6 THEN concat('//cdn.example/blog/', CAST(l_partkey AS STRING)) ELSE concat('?id=', CAST(l_partkey AS STRING)) END AS href
FROM {lineitem}"""
_ABSOLUTE = r"""
CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '//') THEN concat('https:', href)
  WHEN starts_with(href, '/') THEN concat(regexp_extract(base, '^https://[^/]+'), href)
  WHEN starts_with(href, '?') THEN concat(regexp_extract(base, '^[^?]+'), href)
  ELSE concat(regexp_extract(base, '^https://[^/]+'), '/c/', href) END"""
DERIVED["absolute"] = f"SELECT *, {_ABSOLUTE} AS url FROM {{link}}"


def _absolute(b):
    return b.link.withColumn("url", urls.absolute_url(F.col("href"), F.col("base")))


@query("absolute_url", f"SELECT {_ITEM}, url FROM {{absolute}}")
def absolute_url(b):
    return _absolute(b).select(*_ITEMS, "url")


@query("sku_from_url", f"""
SELECT {_ITEM}, COALESCE(NULLIF(regexp_extract(path, '/dp/([A-Z0-9]+)', 1, 'i'), ''),
  NULLIF(replace(regexp_extract(query, '(?:^|&)pid=([^&]+)', 1), '%20', ' '), ''), NULLIF(left(regexp_extract(query, '(?:^|&)sku=([^&]+)', 1), 120), ''),
  NULLIF(left(regexp_extract(query, '(?:^|&)id=([^&]+)', 1), 120), ''), left(regexp_extract(path, '([^/]+)/?$', 1), 120)) AS sku
FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query
  FROM {{absolute}}) u""")
def sku_from_url(b):
    return _absolute(b).select(*_ITEMS, urls.sku_from_url(F.col("url"), ("sku", "id")).alias("sku"))


@query("canonical_url", f"""
SELECT {_ITEM}, concat(regexp_extract(url, '^[^?#]+'), CASE WHEN id <> '' THEN concat('?id=', id) ELSE '' END) AS url
FROM (SELECT *, regexp_extract(url, '[?&]id=([^&#]+)', 1) AS id FROM {{absolute}}) u""")
def canonical_url(b):
    return _absolute(b).select(*_ITEMS, urls.canonical_url(F.col("url"), ("sku", "id")).alias("url"))


@query("reject_url", f"""
SELECT {_ITEM}, contains(url, '/blog/') OR contains(url, 'product-detail') OR (l_suppkey % 2 = 0 AND NOT regexp_matches(url, '[0-9]'))
  AS rejected FROM {{absolute}}""")
def reject_url(b):
    parts = F.array(F.lit("/blog/"), F.lit("product-detail"))
    return _absolute(b).select(
        *_ITEMS, urls.rejects_url(F.col("url"), parts, F.expr("l_suppkey % 2 = 0")).alias("rejected")
    )


@query("region_sku", """
SELECT store_id, sku, CASE WHEN store_id % 2 = 0 THEN concat(CAST(sku AS STRING), '-', lower(region)) ELSE CAST(sku AS STRING) END
  AS regional FROM {listing}""")
def region_sku(b):
    suffixed = urls.region_sku(F.col("sku").cast("string"), F.col("region"), F.expr("store_id % 2 = 0"))
    return b.listing.select("store_id", "sku", suffixed.alias("regional"))


@query("url_slug", r"""
SELECT store_id, sku, concat(regexp_replace(left(regexp_replace(regexp_replace(lower(raw_title), '[^a-z0-9]+', '-', 'g'),
  '^-+|-+$', '', 'g'), 100), '-+$', ''), '-', CAST(sku AS STRING)) AS slug FROM {listing}""")
def url_slug(b):
    return b.listing.select("store_id", "sku", urls.url_slug(F.col("raw_title"), F.col("sku").cast("string")).alias("slug"))


#: Page texts that state a number of results, one per line item.
VIEWS["page_text"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_orderkey % 6 WHEN 0 THEN concat('1-24 of ', CAST(l_partkey AS STRING), ' results for switch')
    WHEN 1 THEN concat('1,', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ' items found')
    WHEN 2 THEN concat('Showing 1 to 9 of ', CAST(l_suppkey AS STRING)) WHEN 3 THEN concat('of 0 results; ', CAST(l_partkey AS STRING), ' products found')
    WHEN 4 THEN 'All our games' ELSE concat('showing page. of ', CAST(l_partkey AS STRING)) END AS text
FROM {lineitem}"""


@query("claimed_total", f"SELECT {_ITEM}, {sql.claimed_total('text')} AS total FROM {{page_text}}")
def claimed_total(b):
    return b.page_text.select(*_ITEMS, urls.claimed_total(F.col("text")).alias("total"))


@query("html_unescape", """
SELECT store_id, sku, concat(replace(raw_title, '–', '—'), ' & ©') AS title FROM {listing}""")
def html_unescape(b):
    """Titles with their dashes and signs written as entities, decoded again."""
    encoded = F.concat(F.replace("raw_title", F.lit("–"), F.lit("&#8212;")), F.lit(" &amp; &copy"))
    return b.listing.select("store_id", "sku", values.html_unescape(encoded).alias("title"))


#: Timestamps as text: with and without a zone, and broken.
VIEWS["stamp"] = """
SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T10:11:12Z')
  WHEN 1 THEN concat(CAST(CAST(ts AS DATE) AS STRING), ' 10:11:12') WHEN 2 THEN concat(CAST(CAST(ts AS DATE) AS STRING), 'T15:41:12+05:30')
  ELSE concat('on ', CAST(CAST(ts AS DATE) AS STRING)) END AS text FROM {events}"""


@query("parse_ts_utc", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '10' HOUR + INTERVAL '11' MINUTE
  + INTERVAL '12' SECOND END AS at_utc FROM {stamp}""")
def parse_ts_utc(b):
    return b.stamp.select("event_id", values.parse_ts_utc(F.col("text")).alias("at_utc"))


VIEWS["id_list"] = """
SELECT store_id, sku, concat(CAST(store_id AS STRING), CASE sku % 3 WHEN 0 THEN ', ' WHEN 1 THEN ' ,, ' ELSE ',' END,
  CAST(sku AS STRING), CASE WHEN sku % 2 = 0 THEN ' ,' ELSE '' END) AS ids FROM {listing}"""


@query("parse_ids", """
SELECT store_id, sku, concat(CAST(store_id AS STRING), '|', CAST(sku AS STRING)) AS ids, CAST(2 AS INT) AS n FROM {id_list}""")
def parse_ids(b):
    parsed = values.parse_ids(F.col("ids"))
    return b.id_list.select("store_id", "sku", F.array_join(parsed, "|").alias("ids"), F.size(parsed).alias("n"))


# ---- the grouping pass -----------------------------------------------------

DERIVED["keyed"] = f"""
SELECT raw_title, stored_platform, key, COALESCE({sql.named_platform('raw_title')}, stored_platform) AS platform FROM (
{sql.match_keys('(SELECT DISTINCT raw_title, platform AS stored_platform FROM {listing}) t')}) k"""
DERIVED["base_key"] = """
SELECT k.key, k.platform, COUNT(*) AS n FROM {listing} l
JOIN {keyed} k ON l.raw_title = k.raw_title AND l.platform = k.stored_platform
WHERE k.key <> '' AND k.platform <> 'UNKNOWN' GROUP BY k.key, k.platform"""
DERIVED["stripped"] = f"""
SELECT b.key, b.platform, {sql.confirmed_rest('b.key')} AS stripped FROM {{base_key}} b
WHERE {sql.confirmed_rest('b.key')} <> ''
  AND EXISTS (SELECT 1 FROM {{base_key}} o WHERE o.key = {sql.confirmed_rest('b.key')} AND o.platform = b.platform)"""
DERIVED["uses"] = """
SELECT COALESCE(s.stripped, b.key) AS key, b.platform, CAST(SUM(n) AS BIGINT) AS uses
FROM {base_key} b LEFT JOIN {stripped} s ON b.key = s.key AND b.platform = s.platform GROUP BY 1, 2"""
DERIVED["canonical"] = f"""
SELECT key, platform, first_value(key) OVER (PARTITION BY platform, {sql.word_set('key')} ORDER BY uses DESC, length(key), key)
  AS canonical FROM {{uses}} WHERE NOT list_contains(string_split(key, ' '), 'vs')"""
DERIVED["final_key"] = """
SELECT b.key, b.platform, COALESCE(c.canonical, s.stripped, b.key) AS game FROM {base_key} b
LEFT JOIN {stripped} s ON b.key = s.key AND b.platform = s.platform
LEFT JOIN {canonical} c ON c.key = COALESCE(s.stripped, b.key) AND c.platform = b.platform"""
DERIVED["alias_key"] = f"""
SELECT key, target FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS nth FROM (
{sql.match_keys('(' + sql.match_keys('{aliases}', 'from_title', 'key') + ') f', 'to_title', 'target')}) a WHERE target <> '') r WHERE nth = 1"""
DERIVED["game_of"] = """
SELECT key, platform, CASE WHEN target IS NULL THEN game ELSE COALESCE(c2, s2, target) END AS game FROM (
  SELECT f.key, f.platform, f.game, t.target, s.stripped AS s2, c.canonical AS c2
  FROM {final_key} f LEFT JOIN {alias_key} a ON a.key = f.key LEFT JOIN {alias_key} g ON g.key = f.game
  CROSS JOIN LATERAL (SELECT COALESCE(a.target, g.target) AS target) t
  LEFT JOIN {stripped} s ON s.key = t.target AND s.platform = f.platform
  LEFT JOIN {canonical} c ON c.key = COALESCE(s.stripped, t.target) AND c.platform = f.platform) r"""
DERIVED["assigned"] = """
SELECT l.store_id, l.sku, l.raw_title, l.region, k.platform, g.game, l.platform AS stored_platform, l.game AS stored_game
FROM {listing} l JOIN {keyed} k ON l.raw_title = k.raw_title AND l.platform = k.stored_platform
LEFT JOIN {game_of} g ON g.key = k.key AND g.platform = k.platform"""


def _assigned(b):
    return matching.assign_games(b.listing, b.aliases)


@query("platform_relabel", f"""
SELECT raw_title, platform, COALESCE({sql.named_platform('raw_title')}, platform) AS relabelled FROM {{title}}""")
def platform_relabel(b):
    return b.title.select(
        "raw_title", "platform", matching.platform_relabel(F.col("raw_title"), F.col("platform")).alias("relabelled")
    )


@query("src_aliases", "SELECT key, target FROM {alias_key}")
def src_aliases(b):
    return matching.aliases_by_key(b.aliases)


def _base_keys(b):
    """Distinct keys with their listing counts, held as in the whole pass."""
    keyed = matching.keyed_titles(b.listing).where("key <> '' AND platform <> 'UNKNOWN'")
    return hold(keyed.groupBy("key", "platform").agg(F.sum("n").alias("n")))


@query("confirmed_prefix_join", "SELECT key, platform, stripped FROM {stripped}")
def confirmed_prefix_join(b):
    return matching.confirmed_prefix_join(_base_keys(b)).select("key", "platform", "stripped")


@query("canonical_key", "SELECT key, platform, canonical FROM {canonical} WHERE key <> canonical")
def canonical_key(b):
    keys = _base_keys(b)
    once = matching._follow(keys, "key", matching.confirmed_prefix_join(keys), "stripped")
    uses = once.groupBy("key", "platform").agg(F.sum("n").alias("uses"))
    return matching.canonical_keys(uses)


@query("alias_join", "SELECT key, platform, game FROM {game_of}")
def alias_join(b):
    return matching.key_mapping(_base_keys(b), b.aliases)


@query("assign_games", "SELECT store_id, sku, platform, game FROM {assigned}")
def assign_games(b):
    return _assigned(b).select("store_id", "sku", "platform", "game")


@query("game_table", "SELECT DISTINCT game, platform, region FROM {assigned} WHERE game IS NOT NULL")
def game_table(b):
    return matching.game_table(_assigned(b))


@query("game_redirects", """
WITH moved AS (
  SELECT stored_game AS old_title, stored_platform AS platform, MIN(game) AS new_title FROM {assigned}
  WHERE stored_game IS NOT NULL GROUP BY 1, 2
  HAVING COUNT(DISTINCT game) = 1 AND COUNT(*) = COUNT(game)),
merged AS (
  SELECT * FROM moved UNION ALL
  SELECT r.old_title, r.platform, r.new_title FROM {redirect} r
  WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.old_title = r.old_title AND m.platform = r.platform))
SELECT * FROM merged m WHERE NOT EXISTS (
  SELECT 1 FROM {assigned} a WHERE a.game = m.old_title AND a.platform = m.platform)""")
def game_redirects(b):
    return matching.game_redirects(_assigned(b), b.redirect)


@query("rematch_preview", """
SELECT game, platform, stored_group, stored_platform, listings, merged_groups FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY game, platform) AS merged_groups FROM (
    SELECT game, platform, COALESCE(stored_game, '(ungrouped)') AS stored_group, stored_platform, COUNT(*) AS listings
    FROM {assigned} WHERE game IS NOT NULL GROUP BY 1, 2, 3, 4) s) m
WHERE merged_groups > 1""")
def rematch_preview(b):
    return matching.rematch_preview(_assigned(b))


@query("rematch_relabelled", """
SELECT store_id, sku, raw_title, stored_platform, platform FROM {assigned} WHERE game IS NOT NULL AND platform <> stored_platform""")
def rematch_relabelled(b):
    return matching.relabelled_platforms(_assigned(b))


@query("subset_key_join", f"""
WITH games AS (
  SELECT game, platform, {sql.word_set('game')} AS words FROM (
    SELECT DISTINCT game, platform FROM {{assigned}} WHERE game IS NOT NULL) g),
edition AS (
  SELECT DISTINCT game, platform, unnest(regexp_extract_all(lower(raw_title), '(\\w+)\\W+edition\\b', 1)) AS word
  FROM {{assigned}} WHERE game IS NOT NULL),
reduced AS (
  SELECT game, platform, words, unnest(list_concat(list_transform(free, lambda a: [a]),
    flatten(list_transform(free, lambda a: list_transform(list_filter(free, lambda c: c > a), lambda d: [a, d]))))) AS extra
  FROM (SELECT *, list_filter(words, lambda w: NOT {sql.variant_word('w')}) AS free FROM games) f)
SELECT DISTINCT r.platform, s.game AS short_key, r.game AS long_key FROM reduced r JOIN games s
  ON s.platform = r.platform AND s.words = list_filter(r.words, lambda w: NOT list_contains(r.extra, w))
WHERE len(string_split(s.game, ' ')) >= 2 AND NOT EXISTS (
  SELECT 1 FROM edition e WHERE e.game = r.game AND e.platform = r.platform AND list_contains(r.extra, e.word))""")
def subset_key_join(b):
    return matching.subset_key_join(_assigned(b))


@query("sample_per_group", """
SELECT game, platform, CAST(nth AS INT) AS nth, store_id, raw_title FROM (
  SELECT *, row_number() OVER (PARTITION BY game, platform ORDER BY store_id, sku) AS nth FROM {assigned} WHERE game IS NOT NULL) s
WHERE nth <= 3""")
def sample_per_group(b):
    return matching.sample_per_group(_assigned(b), 3)

