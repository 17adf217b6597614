"""Runs, events, upserts, exchange rates, audits and batch checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.operators import audit, dedupe, events, fx, monitoring, upserts
from pricetide.plans.registry import query
from pricetide.plans.views import DERIVED, VIEWS


@query("summary", """
SELECT (SELECT COUNT(*) FROM {listing}) AS listings, (SELECT COUNT(DISTINCT store_id) FROM {listing}) AS stores,
  (SELECT COUNT(*) FROM {listing} WHERE game IS NULL) AS unmatched, (SELECT COUNT(*) FROM {price_point}) AS points,
  (SELECT COUNT(*) FROM {mover} WHERE pct < 0 AND NOT fx_suspect) AS price_drops""")
def summary(b):
    return monitoring.summary(b.tables)


@query("has_ever_collected", "SELECT COUNT(*) > 0 AS has_collected FROM {run_store}")
def has_ever_collected(b):
    return monitoring.has_ever_collected(b.run_store)


_HEALTH = """SELECT r.store_id, s.name, s.tier, r.status, r.listings_found, r.duration_ms, r.detail, u.started_at, u.finished_at
FROM {run_store} r JOIN {store} s ON r.store_id = s.store_id JOIN {run} u ON u.run_id = r.run_id WHERE r.run_id = (SELECT MAX(run_id) FROM {run})"""


@query("health", _HEALTH)
def health(b):
    return monitoring.health(b.tables)


@query("health_by_severity", f"""
SELECT *, CAST(CASE status WHEN 'failed' THEN 0 WHEN 'skipped' THEN 1 WHEN 'partial' THEN 2 WHEN 'ok' THEN 3 ELSE 9 END AS INT)
  AS severity, status IN ('failed', 'skipped') AS needs_attention FROM ({_HEALTH}) h""")
def health_by_severity(b):
    return monitoring.health_by_severity(b.tables)


@query("health_attention", f"""
SELECT COUNT(*) AS stores, COUNT(*) FILTER (WHERE status IN ('failed', 'skipped')) AS need_attention FROM ({_HEALTH}) h""")
def health_attention(b):
    return monitoring.attention_count(b.tables)


_GOOD = "SELECT run_id FROM {run_store} WHERE status IN ('ok', 'partial')"


@query("has_ok_store_semi", f"SELECT run_id, started_at, finished_at FROM {{run}} WHERE finished_at IS NOT NULL AND run_id IN ({_GOOD})")
def has_ok_store_semi(b):
    return monitoring.successful_runs(b.run, b.run_store).select("run_id", "started_at", "finished_at")


@query("last_successful_run", f"SELECT MAX(finished_at) AS last_finished FROM {{run}} WHERE run_id IN ({_GOOD})")
def last_successful_run(b):
    return monitoring.last_successful_run(b.run, b.run_store)


_SLOT = """CASE WHEN date_trunc('day', moment) + INTERVAL '7' HOUR + INTERVAL '30' MINUTE <= moment
  THEN date_trunc('day', moment) + INTERVAL '7' HOUR + INTERVAL '30' MINUTE
  ELSE date_trunc('day', moment) + INTERVAL '7' HOUR + INTERVAL '30' MINUTE - INTERVAL '1' DAY END"""


@query("slot_due", f"""
SELECT moment, slot_at, NOT EXISTS (
  SELECT 1 FROM {{run}} r WHERE r.finished_at >= slot_at AND r.finished_at <= moment AND r.run_id IN ({_GOOD})) AS due
FROM (SELECT moment, CAST({_SLOT} AS TIMESTAMP) AS slot_at FROM (
  SELECT DISTINCT captured_at + point_id % 24 * INTERVAL '1' HOUR AS moment FROM {{price_point}}) m) q""")
def slot_due(b):
    """For every hour of the collected days: is the 07:30 collection still due?"""
    hours = F.expr("captured_at + make_dt_interval(0, CAST(point_id % 24 AS INT), 0, 0)")
    moments = b.price_point.select(hours.alias("moment")).distinct()
    return monitoring.slot_due(moments, b.run, b.run_store, "07:30")


@query("store_history", """
SELECT store_id, CAST(nth AS INT) AS nth, started_at, status, listings_found, detail FROM (
  SELECT s.*, r.started_at, row_number() OVER (PARTITION BY s.store_id ORDER BY r.started_at DESC, s.run_id DESC) AS nth
  FROM {run_store} s JOIN {run} r ON s.run_id = r.run_id) h WHERE nth <= 5""")
def store_history(b):
    return monitoring.store_history(b.run, b.run_store, 5)


@query("run_store_latest", VIEWS["run_store"])
def run_store_latest(b):
    return monitoring.run_store_latest(b.run_store_log, ["attempt"]).select(
        "run_id", "store_id", "status", "listings_found", "duration_ms", "detail"
    )


#: Observations as they arrive: today's listing text, with what only an observation knows.
_OBSERVED = """
SELECT p.store_id, p.sku, p.point_id, p.run_id, p.captured_at, p.native_currency, p.native_price, p.in_stock,
  CASE WHEN p.point_id % 19 = 0 THEN 'javascript:void(0)' WHEN p.point_id % 23 = 0 THEN concat('/relative/', p.sku)
    WHEN p.point_id % 29 = 0 THEN concat(' HTTPS://shop/a b?run=', p.run_id) ELSE concat(l.url, '?run=', p.run_id) END AS url,
  concat(l.raw_title, CASE WHEN p.point_id % 2 = 0 THEN ' ' ELSE ' (Used)' END) AS raw_title, l.platform, l.region,
  CASE WHEN p.point_id % 2 = 0 THEN 'NEW' ELSE 'PRE_OWNED' END AS condition,
  CASE WHEN p.point_id % 3 = 0 THEN NULL ELSE concat('/img/', p.point_id) END AS image_url
FROM {price_point} p JOIN {listing} l ON p.store_id = l.store_id AND p.sku = l.sku"""
VIEWS["observed"] = _OBSERVED
_WEB = r"regexp_matches(replace(url, chr(9), ''), '^[\x00-\x20]*https?:', 'i')"


@query("web_url_only", f"SELECT store_id, sku, point_id, url FROM {{observed}} WHERE {_WEB}")
def web_url_only(b):
    return upserts.web_url_only(b.observed).select("store_id", "sku", "point_id", "url")


@query("dropped_links", f"""
SELECT store_id, COUNT(*) AS dropped FROM {{observed}} WHERE NOT {_WEB} GROUP BY store_id""")
def dropped_links(b):
    return upserts.dropped_links(b.observed)


@query("listing_upsert", """
SELECT n.store_id, n.sku, n.url, n.raw_title, n.platform, n.region, n.condition, o.image_url, o.captured_at AS first_seen,
  n.captured_at AS last_seen
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY captured_at DESC, point_id DESC) AS nth FROM {observed}) n
JOIN (SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY captured_at, point_id) AS nth FROM {observed}) o
  ON n.store_id = o.store_id AND n.sku = o.sku WHERE n.nth = 1 AND o.nth = 1""")
def listing_upsert(b):
    return upserts.listing_upsert(b.observed, ["captured_at", "point_id"])


_ASOF = """
SELECT o.store_id, o.sku, o.point_id, o.native_currency, o.native_price,
  CASE WHEN o.native_currency = 'INR' THEN 1e0 ELSE r.rate END AS rate,
  CASE WHEN o.native_currency = 'INR' THEN CAST(o.captured_at AS DATE) ELSE r.rate_date END AS rate_date
FROM {price_point} o ASOF LEFT JOIN (SELECT base, rate, rate_date FROM {fx_rate} WHERE quote = 'INR') r
  ON o.native_currency = r.base AND CAST(o.captured_at AS DATE) >= r.rate_date"""
_ASOF_COLUMNS = ["store_id", "sku", "point_id", "native_currency", "native_price"]


@query("fx_asof", _ASOF)
def fx_asof(b):
    return fx.fx_asof(b.price_point, b.fx_rate).select(*_ASOF_COLUMNS, "rate", "rate_date")


@query("append_price_points", f"""
SELECT store_id, sku, point_id, native_price, CAST(printf('%.2f', native_price * rate) AS DOUBLE) AS inr_price,
  rate_date AS fx_rate_date FROM ({_ASOF}) a""")
def append_price_points(b):
    """Written to a partitioned folder and read back."""
    from pricetide.session import work_dir

    path = work_dir(b.spark, "price-points")
    points = upserts.price_points(b.price_point.drop("inr_price", "fx_rate_date"), b.fx_rate)
    upserts.append_price_points(points, path)
    return b.spark.read.parquet(path).select("store_id", "sku", "point_id", "native_price", "inr_price", "fx_rate_date")


@query("fx_convert", f"""
SELECT store_id, sku, point_id, CAST(printf('%.2f', native_price * rate) AS DOUBLE) AS inr FROM ({_ASOF}) a""")
def fx_convert(b):
    from pricetide.functions.prices import fx_convert as convert

    return fx.fx_asof(b.price_point, b.fx_rate).select(
        "store_id", "sku", "point_id", convert(F.col("native_price"), F.col("rate")).alias("inr")
    )


@query("fx_rate_upsert", VIEWS["fx_rate"])
def fx_rate_upsert(b):
    return upserts.fx_rate_upsert(b.fx_fetch, ["fetch_id"]).select("base", "quote", "rate", "rate_date")


@query("fold_run_events", VIEWS["run_event"])
def fold_run_events(b):
    return events.fold_run_events(b.run_report)


_CURSORS = "SELECT run_id, MIN(seq) + (MAX(seq) - MIN(seq)) // 3 AS after_seq FROM {run_event} GROUP BY run_id"


@query("events_since", f"""
SELECT e.*, c.after_seq FROM {{run_event}} e JOIN ({_CURSORS}) c ON e.run_id = c.run_id WHERE e.seq > c.after_seq""")
def events_since(b):
    """Every run replayed from a cursor a third of the way in."""
    span = F.floor((F.max("seq") - F.min("seq")) / 3).cast("bigint")
    cursors = b.run_event.groupBy("run_id").agg((F.min("seq") + span).alias("after_seq"))
    return events.events_after_cursors(b.run_event, cursors)


@query("run_finished_flag", "SELECT run_id, bool_or(kind = 'run_finished') AS finished FROM {run_event} GROUP BY run_id")
def run_finished_flag(b):
    return events.run_finished_flag(b.run_event)


PROGRESS = """
SELECT run_id, arg_max(count, seq) FILTER (WHERE kind = 'run_started') AS total,
  COUNT(*) FILTER (WHERE kind = 'store_finished') AS done,
  COUNT(*) FILTER (WHERE kind = 'store_finished' AND status IN ('failed', 'skipped')) AS failed,
  CAST(COALESCE(SUM(count) FILTER (WHERE kind = 'store_finished'), 0) AS BIGINT) AS listings,
  arg_max(store_id, seq) FILTER (WHERE kind IN ('store_started', 'store_progress')) AS current_store,
  arg_max(CASE WHEN kind = 'store_progress' THEN page ELSE 0 END, seq) FILTER (WHERE kind IN ('store_started', 'store_progress'))
    AS current_page, MAX(seq) AS last_seq
FROM {run_event} GROUP BY run_id"""


@query("run_progress", PROGRESS)
def run_progress(b):
    return events.run_progress(b.run_event)


@query("store_progress", """
SELECT run_id, store_id, arg_max(count, seq) FILTER (WHERE count IS NOT NULL) AS listings, MAX(page) AS page,
  arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, MAX(seq) AS last_seq
FROM {run_event} WHERE store_id IS NOT NULL GROUP BY run_id, store_id""")
def store_progress(b):
    return events.store_progress(b.run_event)


DERIVED["audit"] = """
SELECT l.store_id, COUNT(*) AS listings,
  COUNT(*) FILTER (WHERE (l.raw_title LIKE '%...' OR l.raw_title LIKE '%…') AND c.sku IS NOT NULL) AS cut_titles,
  COUNT(*) FILTER (WHERE COALESCE(p.native_price <= 0, FALSE) OR COALESCE(p.inr_price <= 0, FALSE)) AS bad_prices,
  COUNT(*) FILTER (WHERE p.sku IS NOT NULL AND p.inr_price IS NULL) AS no_rupee_price,
  COUNT(*) FILTER (WHERE l.game IS NULL AND l.platform <> 'UNKNOWN') AS ungrouped
FROM {listing} l LEFT JOIN {latest} p ON l.store_id = p.store_id AND l.sku = p.sku
LEFT JOIN (
  SELECT DISTINCT p.store_id, p.sku FROM {price_point} p
  JOIN (SELECT store_id, MAX(run_id) AS run_id FROM {price_point} GROUP BY store_id) r
    ON p.store_id = r.store_id AND p.run_id = r.run_id) c ON l.store_id = c.store_id AND l.sku = c.sku
GROUP BY l.store_id"""


@query("audit_per_store", "SELECT * FROM {audit}")
def audit_per_store(b):
    return audit.audit_per_store(b.tables)


@query("audit_verdict", """
SELECT CAST(SUM(cut_titles + bad_prices) AS BIGINT) AS problems, SUM(cut_titles + bad_prices) = 0 AS ok FROM {audit}""")
def audit_verdict(b):
    return audit.audit_verdict(audit.audit_per_store(b.tables))


@query("shared_games", """
SELECT COUNT(*) AS games, COUNT(*) FILTER (WHERE stores > 1) AS shared_games FROM (
  SELECT COUNT(DISTINCT store_id) AS stores FROM {listing} WHERE game IS NOT NULL GROUP BY game, platform) g""")
def shared_games(b):
    return audit.shared_games(b.listing)


@query("ungrouped_list", "SELECT store_id, sku, raw_title FROM {listing} WHERE game IS NULL AND platform <> 'UNKNOWN'")
def ungrouped_list(b):
    return audit.ungrouped_list(b.listing)


#: A scrape batch with every fault in it: one SKU per four parts, odd prices, foreign currencies, missing links.
VIEWS["batch"] = """
SELECT store_id, CASE WHEN sku % 1000 = 999 THEN '' ELSE CAST(CASE WHEN store_id % 4 = 1 THEN sku // 4 ELSE sku END AS STRING) END
    AS sku, run_id, point_id,
  CASE WHEN sku % 500 = 7 THEN native_price * 1000e0 ELSE native_price END AS native_price,
  CASE WHEN point_id % 301 = 0 THEN 'AUD' ELSE native_currency END AS native_currency,
  in_stock AND store_id % 6 <> 5 AS in_stock, CASE WHEN store_id % 9 = 4 THEN NULL ELSE 'https://x/y' END AS url
FROM {price_point}""".replace("sku // 4", "CAST(floor(sku / 4) AS BIGINT)")
VIEWS["pushed"] = """
SELECT store_id, CAST(floor(COUNT(*) * (1e0 + (store_id % 4) / 5e0)) AS BIGINT) AS raw_rows FROM {batch} GROUP BY store_id"""


@query("batch_audit", f"""
WITH kept AS (
  SELECT b.store_id, COUNT(*) AS kept, COUNT(*) FILTER (WHERE sku = '') AS blank_sku,
    COUNT(*) FILTER (WHERE native_price <= 0) AS price_not_positive,
    COUNT(*) FILTER (WHERE native_price > {vocab.STEEP_PRICE}) AS price_too_steep,
    COUNT(*) FILTER (WHERE native_currency <> s.currency) AS foreign_currency,
    COUNT(*) FILTER (WHERE in_stock) AS stocked, COUNT(url) AS linked
  FROM {{batch}} b JOIN {{store}} s ON b.store_id = s.store_id GROUP BY b.store_id),
dup AS (SELECT store_id, COUNT(*) AS duplicate_sku FROM (
  SELECT store_id, sku FROM {{batch}} GROUP BY store_id, sku HAVING COUNT(*) > 1) d GROUP BY store_id)
SELECT * FROM (
  SELECT k.store_id, 'pages_may_repeat' AS warning, raw_rows - kept AS n FROM kept k JOIN {{pushed}} p ON k.store_id = p.store_id
    WHERE kept < raw_rows * 0.75e0
  UNION ALL SELECT store_id, 'duplicate_sku', duplicate_sku FROM dup
  UNION ALL SELECT store_id, 'blank_sku', blank_sku FROM kept
  UNION ALL SELECT store_id, 'price_not_positive', price_not_positive FROM kept
  UNION ALL SELECT store_id, 'price_too_steep', price_too_steep FROM kept
  UNION ALL SELECT store_id, 'foreign_currency', foreign_currency FROM kept
  UNION ALL SELECT store_id, 'all_out_of_stock', kept FROM kept WHERE stocked = 0
  UNION ALL SELECT store_id, 'no_url', kept FROM kept WHERE linked = 0) w WHERE n > 0""")
def batch_audit(b):
    return audit.batch_audit(b.batch, b.pushed, b.store)


@query("duplicate_rate", """
SELECT run_id, store_id, CAST(COUNT(*) AS BIGINT) AS raw_rows, COUNT(DISTINCT sku) AS unique_rows,
  1 - COUNT(DISTINCT sku) / COUNT(*) AS duplicate_rate, 1 - COUNT(DISTINCT sku) / COUNT(*) > 0.4e0 AS warn
FROM {batch} GROUP BY run_id, store_id""")
def duplicate_rate(b):
    return audit.duplicate_rate(b.batch)


#: Products per category: each part sorted under its type and brand by the stores selling it.
VIEWS["category_product"] = """
SELECT l.store_id, concat(p_type, '/', p_brand) AS category, CAST(l.sku AS STRING) AS sku
FROM {listing} l JOIN {part} ON l.sku = p_partkey"""


#: The categories each shop is configured with, some of them empty.
VIEWS["store_category"] = """
SELECT DISTINCT store_id, category FROM {category_product}
UNION ALL SELECT store_id, concat('empty-', CAST(store_id % 3 AS STRING)) AS category FROM {store}"""


@query("category_low", """
SELECT c.store_id, c.category, COUNT(p.sku) AS products, COUNT(p.sku) <= 1 AS suspicious
FROM {store_category} c LEFT JOIN {category_product} p ON p.store_id = c.store_id AND p.category = c.category GROUP BY 1, 2""")
def category_low(b):
    return audit.category_low(b.category_product, b.store_category)


VIEWS["fetched"] = """
SELECT store_id, run_id, COUNT(DISTINCT CASE WHEN in_stock THEN sku END) AS kept, COUNT(*) AS seen,
  CASE WHEN run_id % 5 = 0 THEN NULL ELSE COUNT(*) + run_id % 3 END AS claimed, store_id % 2 = 0 AS exact,
  CASE WHEN (store_id + run_id) % 11 = 0 THEN 'page 3: HTTP 500' END AS problems
FROM {price_point} GROUP BY store_id, run_id"""


@query("completeness", """
SELECT store_id, run_id,
  CASE WHEN kept = 0 THEN 'failed' WHEN problems IS NOT NULL OR short THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN kept = 0 AND problems IS NULL THEN concat('nothing extracted', note) WHEN kept = 0 AND exact THEN problems
    WHEN problems IS NOT NULL THEN concat(problems, note) WHEN short THEN concat('stopped early', note) END AS reason
FROM (
  SELECT *, COALESCE(claimed > 0 AND CASE WHEN exact THEN seen < claimed ELSE seen < claimed * 0.9e0 END, FALSE) AS short,
    CASE WHEN COALESCE(claimed > 0, FALSE) AND exact THEN printf(' (fetched %d of %d in category)', seen, claimed)
      WHEN COALESCE(claimed > 0, FALSE) THEN printf(' (page claims about %d, %d rows seen)', claimed, seen) ELSE '' END AS note
  FROM {fetched}) f""")
def completeness(b):
    return monitoring.completeness(b.fetched).select("store_id", "run_id", "outcome.*")


#: Page walks: a store's year is a walk and its months the pages; a month without rows is an empty page.
VIEWS["walked"] = """
SELECT store_id, CAST(floor((run_id - 1) / 12) AS BIGINT) AS walk, (run_id - 1) % 12 + 1 AS page, point_id AS row_id,
  sku % 7 AS sku, in_stock AS kept
FROM {price_point}"""
VIEWS["walk_rows"] = """
SELECT store_id, walk, page, row_id, sku, kept FROM {walked} WHERE (store_id + page) % 13 <> 0
UNION ALL
SELECT w.store_id, w.walk, m.page, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS sku, FALSE AS kept
FROM (SELECT DISTINCT store_id, walk FROM {walked}) w JOIN (SELECT DISTINCT walk, page FROM {walked}) m ON w.walk = m.walk"""
_YIELD = """
SELECT r.store_id, r.walk, r.page, COUNT(row_id) AS raw_rows, COUNT(*) FILTER (WHERE kept) AS kept_rows,
  COALESCE(MAX(n.new_rows), 0) AS new_rows
FROM {walk_rows} r LEFT JOIN (
  SELECT store_id, walk, page, COUNT(*) AS new_rows FROM (
    SELECT store_id, walk, sku, MIN(page) AS page FROM {walk_rows} WHERE kept GROUP BY store_id, walk, sku) f
  GROUP BY store_id, walk, page) n ON r.store_id = n.store_id AND r.walk = n.walk AND r.page = n.page
GROUP BY r.store_id, r.walk, r.page"""
DERIVED["page_yield"] = _YIELD
_WALK = ["store_id", "walk"]


@query("page_yield", "SELECT * FROM {page_yield}")
def page_yield(b):
    return dedupe.page_yield(b.walk_rows, _WALK)


@query("productivity_streak", """
WITH scored AS (
  SELECT *, raw_rows > 0 AND (new_rows = 0 OR
    new_rows / CASE WHEN kept_rows > 0 THEN kept_rows ELSE raw_rows END < 0.15e0) AS poor FROM {page_yield}),
streaks AS (
  SELECT *, SUM(CASE WHEN poor THEN 1 ELSE 0 END) OVER (
    PARTITION BY store_id, walk ORDER BY page ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM scored),
ends AS (
  SELECT store_id, walk, MAX(page) AS last_page, MIN(CASE WHEN raw_rows = 0 THEN page END) AS empty_page,
    MIN(CASE WHEN recent = 4 THEN page END) AS streak_page FROM streaks GROUP BY store_id, walk)
SELECT store_id, walk, least(streak_page, empty_page, last_page) AS stop_page,
  CASE WHEN empty_page = least(streak_page, empty_page, last_page) THEN 'empty page'
    WHEN streak_page = least(streak_page, empty_page, last_page) THEN 'unproductive' ELSE 'end of walk' END AS reason
FROM ends""")
def productivity_streak(b):
    return dedupe.productivity_streak(dedupe.page_yield(b.walk_rows, _WALK), _WALK)


#: Feed rows whose SKU field is typed by hand: some products share one, some come twice.
VIEWS["feed_row"] = """
SELECT store_id, point_id AS pos, CAST(sku AS STRING) AS product_id,
  CASE WHEN sku % 10 < 3 THEN concat('S', CAST(sku % 20 AS STRING)) ELSE concat('P', CAST(sku AS STRING)) END AS sku, native_price
FROM {price_point}"""


@query("one_product_per_sku", """
SELECT store_id, pos, product_id, sku, native_price FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY pos, product_id, native_price) AS nth FROM (
    SELECT r.store_id, pos, product_id, CASE WHEN n > 1 THEN product_id ELSE r.sku END AS sku, native_price
    FROM {feed_row} r JOIN (SELECT store_id, sku, COUNT(DISTINCT product_id) AS n FROM {feed_row} GROUP BY store_id, sku) c
      ON r.store_id = c.store_id AND r.sku = c.sku) o) f WHERE nth = 1""")
def one_product_per_sku(b):
    return dedupe.one_product_per_sku(b.feed_row, ["pos", "product_id", "native_price"])


@query("dedupe_last", """
SELECT store_id, pos, product_id, sku, native_price FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY pos DESC, product_id DESC, native_price DESC) AS nth
  FROM {feed_row}) f WHERE nth = 1""")
def dedupe_last(b):
    return dedupe.dedupe_last(b.feed_row, ["pos", "product_id", "native_price"])
