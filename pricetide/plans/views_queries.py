"""History, listing, offer, mover and facet queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pricetide.operators import facets, history, listings, movers, offers, records, title_index
from pricetide.operators.listings import ListingQuery
from pricetide.operators.paging import cursor_of
from pricetide.plans.registry import query
from pricetide.session import hold, work_dir
from pricetide.tables import LISTING_KEY

_POINT = "store_id, sku, point_id, run_id, captured_at, native_currency, native_price, inr_price, in_stock"
_POINTS = [c.strip() for c in _POINT.split(",")]


@query("nth_latest", f"SELECT {_POINT}, CAST(rn AS INT) AS nth FROM {{ranked}} WHERE rn = 2")
def nth_latest(b):
    return history.nth_latest(b.price_point, 2).select(*_POINTS, F.lit(2).alias("nth"))


@query("nth_latest_stored", f"SELECT {_POINT}, CAST(rn AS INT) AS nth FROM {{ranked}} WHERE rn = 2")
def nth_latest_stored(b):
    """From a history stored by listing."""
    return history.nth_latest(b.stored_tables.price_point, 2).select(*_POINTS, F.lit(2).alias("nth"))


@query("latest_join", f"SELECT l.raw_title, {', '.join('p.' + c for c in _POINTS)} "
       "FROM {listing} l JOIN {latest} p ON l.store_id = p.store_id AND l.sku = p.sku")
def latest_join(b):
    return listings.latest_join(b.listing, b.price_point).select("raw_title", *_POINTS)


@query("previous_join", """
SELECT l.store_id, l.sku, l.raw_title, p.inr_price, p.previous_price
FROM {listing} l JOIN {latest} p ON l.store_id = p.store_id AND l.sku = p.sku""")
def previous_join(b):
    return listings.previous_join(b.listing, b.price_point)


@query("listing_store_join", """
SELECT l.store_id, l.sku, l.raw_title, s.name AS store, s.currency, s.ships_from_abroad
FROM {listing} l JOIN {store} s ON l.store_id = s.store_id""")
def listing_store_join(b):
    return listings.listing_store_join(b.listing, b.store).select(
        "store_id", "sku", "raw_title", "store", "currency", "ships_from_abroad"
    )


_GAMES = "SELECT DISTINCT game, platform FROM {listing} WHERE game IS NOT NULL AND region = 'IN'"


@query("listing_game_join", f"""
SELECT l.store_id, l.sku, g.game, l.platform FROM {{listing}} l LEFT JOIN ({_GAMES}) g
  ON l.game = g.game AND l.platform = g.platform""")
def listing_game_join(b):
    games = b.listing.where("game IS NOT NULL AND region = 'IN'")
    return listings.listing_game_join(b.listing, games, keep_ungrouped=True).select("store_id", "sku", "game", "platform")


@query("facet_left_join", "SELECT store_id, sku, captured_at, inr_price, buyable FROM {priced}")
def facet_left_join(b):
    return facets.facet_left_join(b.tables).select("store_id", "sku", "captured_at", "inr_price", "buyable")


@query("game_semi_join", f"""
SELECT store_id, sku, game, platform FROM {{listing}} WHERE game IN (SELECT game FROM ({_GAMES}) g)""")
def game_semi_join(b):
    games = b.listing.where("game IS NOT NULL AND region = 'IN'")
    return listings.game_semi_join(b.listing, games).select("store_id", "sku", "game", "platform")


_DOMESTIC = "SELECT store_id, sku, region FROM {listing} WHERE store_id NOT IN (SELECT store_id FROM {store} WHERE ships_from_abroad)"


@query("domestic_anti_join", _DOMESTIC)
def domestic_anti_join(b):
    return listings.domestic_only(b.listing, b.store).select("store_id", "sku", "region")


@query("domestic_only", "SELECT store_id, sku, inr_price FROM {offer} WHERE NOT ships_from_abroad")
def domestic_only(b):
    chosen = listings.matching_listings(b.tables, ListingQuery(domestic_only=True))
    return chosen.select("store_id", "sku", "inr_price")


@query("listing_filter", """
SELECT store_id, sku, raw_title, platform, condition, region, inr_price FROM {offer}
WHERE contains(lower(raw_title), 'ring') AND platform = 'SWITCH' AND condition = 'NEW' AND region IN ('IN', 'JP')
  AND NOT ships_from_abroad""")
def listing_filter(b):
    q = ListingQuery(q="RING", platform="SWITCH", condition="NEW", regions=("IN", "JP"), domestic_only=True)
    return listings.matching_listings(b.tables, q).select(
        "store_id", "sku", "raw_title", "platform", "condition", "region", "inr_price"
    )


@query("literal_contains", r"""
SELECT store_id, sku, contains(lower(raw_title), '%') AS has_percent, contains(lower(raw_title), '(japan)') AS has_japan,
  contains(lower(raw_title), 'g_m') AS has_underscore, contains(lower(raw_title), 'pokémon') AS has_accent FROM {listing}""")
def literal_contains(b):
    terms = {"has_percent": "%", "has_japan": "(JAPAN)", "has_underscore": "g_m", "has_accent": "POKÉMON"}
    from pricetide.functions.titles import literal_contains as contains

    return b.listing.select("store_id", "sku", *[contains(F.col("raw_title"), q).alias(n) for n, q in terms.items()])


@query("buyable", """
SELECT p.store_id, p.sku, p.run_id, COALESCE(p.in_stock AND p.run_id >= COALESCE(o.ok_run, 0), FALSE) AS buyable
FROM {latest} p LEFT JOIN {ok_run} o ON p.store_id = o.store_id""")
def buyable(b):
    latest = history.nth_latest(b.price_point)
    return history.with_buyable(latest, b.run_store).select("store_id", "sku", "run_id", "buyable")


@query("change_pct", "SELECT store_id, sku, inr_price, previous_price, change_pct FROM {offer}")
def change_pct(b):
    latest = history.with_change(history.latest_and_previous(b.price_point))
    return latest.select("store_id", "sku", "inr_price", F.col("previous.inr_price").alias("previous_price"), "change_pct")


_MOVER = """SELECT store_id, sku, raw_title, url, region, store, currency, now_price, prev_price, in_stock, captured_at, pct,
  fx_suspect, pct < 0 AND NOT fx_suspect AS is_deal FROM {mover}"""


@query("movers", _MOVER)
def movers_(b):
    return movers.movers(b.tables)


@query("movers_stored", _MOVER)
def movers_stored(b):
    """From tables stored by listing."""
    return movers.movers(b.stored_tables)


@query("mover_store_filter", _MOVER + " WHERE store_id = 3")
def mover_store_filter(b):
    return movers.movers(b.tables, store_id=3)


@query("movers_page", _MOVER + " ORDER BY pct, store_id, sku LIMIT 700 OFFSET 2")
def movers_page(b):
    return movers.movers_page(b.tables, 700, 2)


@query("mover_stores", "SELECT DISTINCT store FROM {mover}")
def mover_stores(b):
    return movers.mover_stores(b.tables)


@query("fx_cluster", """
SELECT native_currency, printf('%.1f', pct) AS pct_bucket, COUNT(*) AS cluster_size,
  COUNT(*) >= 8 AND native_currency <> 'INR' AS fx_suspect FROM {moved} GROUP BY 1, 2""")
def fx_cluster(b):
    return movers.fx_clusters(movers.moves(b.price_point))


_PAGE = """store_id, sku, raw_title, url, region, platform, condition, store, inr_price, native_price, native_currency,
  buyable AS in_stock, captured_at, change_pct"""
_REAL = """previous_price <> 0 AND inr_price <> previous_price
  AND abs((inr_price - previous_price) / NULLIF(previous_price, 0e0) * 100e0) > 1e0"""
#: name -> (query, SQL filter, SQL order, limit, offset); registered as listings_page_<name>.
PAGES = {
    "": (ListingQuery(), "TRUE", "inr_price NULLS FIRST", 100, 0),
    "_price_desc": (ListingQuery(direction="desc", limit=9000, offset=-5), "TRUE", "inr_price DESC NULLS LAST", 9000, 0),
    "_title": (
        ListingQuery(sort="title", in_stock_only=True, offset=30, limit=50), "buyable", "raw_title", 50, 30,
    ),
    "_store_desc": (
        ListingQuery(sort="store", direction="DESC", platform="SWITCH2"), "platform = 'SWITCH2'", "store DESC", 100, 0,
    ),
    "_seen": (
        ListingQuery(sort="seen", direction="desc", condition="PRE_OWNED"), "condition = 'PRE_OWNED'",
        "captured_at DESC", 100, 0,
    ),
    "_change": (ListingQuery(sort="change", limit=0), _REAL, "change_pct NULLS LAST", 1, 0),
    "_change_desc": (
        ListingQuery(sort="change", direction="desc", limit=200, offset=10), _REAL, "change_pct DESC NULLS LAST", 200, 10,
    ),
    "_unknown_sort": (
        ListingQuery(sort="nonsense", direction="sideways", regions=("JP", "EU")), "region IN ('JP', 'EU')",
        "inr_price NULLS FIRST", 100, 0,
    ),
}


def _register_pages() -> None:
    for name, (q, where, order, limit, offset) in PAGES.items():
        sql = f"SELECT {_PAGE} FROM {{offer}} WHERE {where} ORDER BY {order}, store_id, sku LIMIT {limit} OFFSET {offset}"
        query(f"listings_page{name}", sql)(lambda b, q=q: listings.listings_page(b.tables, q))


_register_pages()


@query("listings_page_kept", f"SELECT {_PAGE} FROM {{offer}} WHERE buyable ORDER BY captured_at DESC, store_id, sku LIMIT 250 OFFSET 5")
def listings_page_kept(b):
    q = ListingQuery(sort="seen", direction="desc", in_stock_only=True, limit=250, offset=5)
    return listings.listings_page(b.kept_tables, q)


@query("listings_page_stored", f"SELECT {_PAGE} FROM {{offer}} WHERE buyable ORDER BY raw_title DESC, store_id, sku LIMIT 250 OFFSET 5")
def listings_page_stored(b):
    """From tables stored by listing."""
    q = ListingQuery(sort="title", direction="desc", in_stock_only=True, limit=250, offset=5)
    return listings.listings_page(b.stored_tables, q)


@query("listings_page_after", f"SELECT {_PAGE} FROM {{offer}} WHERE buyable ORDER BY store DESC, store_id, sku LIMIT 80 OFFSET 60")
def listings_page_after(b):
    """The page after the one before it, whose last row is known, as who asks for it has seen it."""
    q = ListingQuery(sort="store", direction="desc", in_stock_only=True, limit=60)
    seen = listings.listings_page(b.tables, q).select(q.sort_column, *LISTING_KEY).tail(1)  # of the page, only what makes its cursor
    cursor = listings.listings_cursor(q, seen[0]) if seen else None
    return listings.listings_page(b.tables, replace(q, limit=80, after=cursor))


@query("movers_kept", _MOVER)
def movers_kept(b):
    return movers.movers(b.kept_tables)


@query("listings_total", f"SELECT COUNT(*) AS total FROM {{offer}} WHERE buyable AND {_REAL}")
def listings_total(b):
    return listings.listings_total(b.tables, ListingQuery(sort="change", in_stock_only=True))


@query("price_history", """
SELECT store_id, sku, captured_at, inr_price, native_price, native_currency, in_stock, fx_rate_date FROM {price_point}""")
def price_history(b):
    return history.price_history(b.price_point)


_STATS = """
SELECT n.store_id, n.sku, now_price, low_price, low_at, high_price, high_at, n_prices, since FROM (
  SELECT store_id, sku, inr_price AS now_price FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY captured_at DESC, point_id DESC) AS nth
    FROM {price_point} WHERE inr_price IS NOT NULL) x WHERE nth = 1) n
JOIN (
  SELECT store_id, sku, inr_price AS low_price, captured_at AS low_at FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY inr_price, captured_at) AS nth
    FROM {price_point} WHERE inr_price IS NOT NULL) x WHERE nth = 1) l ON n.store_id = l.store_id AND n.sku = l.sku
JOIN (
  SELECT store_id, sku, inr_price AS high_price, captured_at AS high_at FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY inr_price DESC, captured_at) AS nth
    FROM {price_point} WHERE inr_price IS NOT NULL) x WHERE nth = 1) h ON n.store_id = h.store_id AND n.sku = h.sku
JOIN (
  SELECT store_id, sku, COUNT(*) AS n_prices, MIN(captured_at) AS since
  FROM {price_point} WHERE inr_price IS NOT NULL GROUP BY store_id, sku) c ON n.store_id = c.store_id AND n.sku = c.sku"""


@query("history_stats", _STATS)
def history_stats(b):
    return history.history_stats(b.price_point)


@query("history_stats_kept", _STATS)
def history_stats_kept(b):
    """From the kept record: the history is not read."""
    return records.history_stats(b.recorded_tables.record)


@query("price_series_scaled", """
SELECT store_id, sku, captured_at, inr_price,
  (t - MIN(t) OVER w) / CASE WHEN MAX(t) OVER w = MIN(t) OVER w THEN 1e0 ELSE MAX(t) OVER w - MIN(t) OVER w END AS x,
  (inr_price - MIN(inr_price) OVER w) / CASE WHEN MAX(inr_price) OVER w = MIN(inr_price) OVER w THEN 1e0
    ELSE MAX(inr_price) OVER w - MIN(inr_price) OVER w END AS y
FROM (SELECT *, CAST(epoch_us(captured_at) AS DOUBLE) AS t FROM {price_point} WHERE inr_price IS NOT NULL) p
WINDOW w AS (PARTITION BY store_id, sku)""")
def price_series_scaled(b):
    return history.price_series_scaled(b.price_point)


@query("games_best_offer", "SELECT * FROM {game_best}")
def games_best_offer(b):
    return offers.games_best_offer(b.tables)


@query("display_title", "SELECT game, platform, title FROM {titled}")
def display_title(b):
    return offers.display_title(b.listing)


@query("lowest_ever", "SELECT game, platform, lowest_ever, runs_seen FROM {lowest}")
def lowest_ever(b):
    return offers.lowest_ever(b.tables)


@query("lowest_ever_kept", "SELECT game, platform, lowest_ever, runs_seen FROM {lowest}")
def lowest_ever_kept(b):
    """From the kept record: the history is not read."""
    return offers.lowest_ever(b.recorded_tables)


@query("lowest_ever_new_domestic", """
SELECT l.game, l.platform, MIN(p.inr_price) AS lowest_ever, COUNT(DISTINCT p.run_id) AS runs_seen
FROM {price_point} p JOIN {listing} l ON l.store_id = p.store_id AND l.sku = p.sku
JOIN {store} s ON s.store_id = l.store_id
WHERE l.game IS NOT NULL AND l.condition = 'NEW' AND NOT s.ships_from_abroad GROUP BY l.game, l.platform""")
def lowest_ever_new_domestic(b):
    return offers.lowest_ever(b.tables, condition="NEW", domestic=True)


@query("at_lowest", "SELECT game, platform, best_price, lowest_ever, runs_seen, at_lowest FROM {game_view}")
def at_lowest(b):
    return offers.games_view(b.tables).select("game", "platform", "best_price", "lowest_ever", "runs_seen", "at_lowest")


@query("price_note", """
SELECT game, platform, CASE WHEN at_lowest THEN 'lowest ever' WHEN lowest_ever < best_price THEN 'lower before' END AS note,
  CASE WHEN NOT at_lowest AND lowest_ever < best_price THEN lowest_ever END AS shown FROM {game_view}""")
def price_note(b):
    return offers.games_view(b.tables).select("game", "platform", *offers.price_note())


_GAME = """game, platform, best_price, best_in_stock, best_url, best_region, best_condition, best_store, offers, stores, title,
  lowest_ever, runs_seen, at_lowest"""
GAME_PAGES = {
    "": (ListingQuery(), "best_price IS NULL, best_in_stock DESC, best_price NULLS FIRST", 100, 0),
    "_price_desc": (
        ListingQuery(direction="desc", limit=40, offset=7), "best_price IS NULL, best_in_stock DESC, best_price DESC NULLS LAST",
        40, 7,
    ),
    "_title": (ListingQuery(sort="title", limit=300), "lower(title)", 300, 0),
    "_offers": (ListingQuery(sort="offers", direction="desc", limit=500), "offers DESC", 500, 0),
}


def _games(b, q: ListingQuery):
    """The products of a query; listings meet their points where they lie, titles need none of that."""
    return offers.games_view(b.dealt_tables, q, b.listing)


def _register_game_pages() -> None:
    for name, (q, order, limit, offset) in GAME_PAGES.items():
        sql = f"SELECT {_GAME} FROM {{game_view}} ORDER BY {order}, game, platform LIMIT {limit} OFFSET {offset}"
        query(f"games_page{name}", sql)(lambda b, q=q: offers.games_page(b.tables, q, _games(b, q)))


_register_game_pages()


@query("game_offers", f"""
SELECT {_PAGE} FROM {{offer}}
WHERE game = (SELECT MIN(game) FROM {{listing}} WHERE platform = 'SWITCH') AND platform = 'SWITCH'
ORDER BY inr_price NULLS FIRST, store_id, sku LIMIT 100""")
def game_offers(b):
    game = b.listing.where("platform = 'SWITCH'").agg(F.min("game")).scalar()
    return listings.game_offers(b.tables, game, "SWITCH")


@query("game_offers_page", f"""
SELECT {_PAGE} FROM {{offer}} WHERE game = (SELECT MAX(game) FROM {{listing}} WHERE platform = 'SWITCH') AND platform = 'SWITCH'
ORDER BY inr_price NULLS FIRST, store_id, sku LIMIT 500 OFFSET 0""")
def game_offers_page(b):
    game = b.listing.where("platform = 'SWITCH'").agg(F.max("game")).scalar()
    return listings.game_offers(b.tables, game, "SWITCH", ListingQuery(limit=500, offset=0))


@query("games_page_after", f"""
SELECT {_GAME} FROM {{game_view}} ORDER BY best_price IS NULL, best_in_stock DESC, best_price DESC NULLS LAST, game, platform
LIMIT 90 OFFSET 40""")
def games_page_after(b):
    """The page after the one before it, both of one held view."""
    q = ListingQuery(direction="desc", limit=40)
    view = hold(_games(b, q))
    seen = offers.games_page(b.tables, q, view).select(cursor_of(offers.games_order(q)).alias("c")).tail(1)
    return offers.games_page(b.tables, replace(q, limit=90, after=tuple(seen[0].c) if seen else None), view)


@query("title_search", r"""
SELECT store_id, sku, raw_title FROM {listing} WHERE contains(lower(raw_title), 'ue ring 1') OR contains(lower(raw_title), 'pokémon hot')""")
def title_search(b):
    """Two searches over one index."""
    index = title_index.build(b.listing, work_dir(b.spark, "titles"), b.buckets)
    found = [title_index.search(b.listing, index, term) for term in ("UE RING 1", "pokémon HOT")]
    return found[0].unionByName(found[1]).select("store_id", "sku", "raw_title").distinct()


@query("title_search_short", "SELECT store_id, sku, raw_title FROM {listing} WHERE contains(lower(raw_title), '7 ')")
def title_search_short(b):
    """Terms too short for the index read all titles."""
    index = title_index.build(b.listing, work_dir(b.spark, "titles"), b.buckets)
    return title_index.search(b.listing, index, "7 ").select("store_id", "sku", "raw_title")


def _facet_sql(where: str, own: dict[str, str] | None = None, source: str = "listing") -> str:
    parts = []
    for name, column in facets.FACETS.items():
        condition = (own or {}).get(name, where)
        parts.append(
            f"SELECT '{name}' AS facet, CAST({column} AS STRING) AS value, "
            f"COUNT(*) FILTER (WHERE COALESCE({condition}, FALSE)) AS n FROM {{{source}}} GROUP BY 2"
        )
    return (
        "SELECT facet, value, COALESCE(CASE WHEN facet = 'stores' THEN s.name END, value) AS label, n "
        f"FROM ({' UNION ALL '.join(parts)}) f LEFT JOIN {{store}} s ON CAST(s.store_id AS STRING) = f.value"
    )


@query("facets", _facet_sql("TRUE"))
def facets_(b):
    return facets.facets(b.tables)


_Q, _R = "contains(lower(raw_title), 'ring') AND buyable", "region IN ('IN', 'EU')"


@query("facets_self_excluding", _facet_sql("TRUE", {"stores": f"{_Q} AND {_R}", "regions": _Q}, "priced"))
def facets_self_excluding(b):
    q = ListingQuery(q="ring", regions=("IN", "EU"), in_stock_only=True)
    return facets.facets_self_excluding(b.tables, q)


@query("facets_unpriced", _facet_sql("TRUE", {"stores": f"{_R} AND condition = 'NEW'", "regions": "condition = 'NEW'"}, "priced"))
def facets_unpriced(b):
    return facets.facets_self_excluding(b.tables, ListingQuery(regions=("IN", "EU"), condition="NEW"))
