"""Grouping, watches, dedupes, sources and streaming on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pricetide.operators import dedupe, matching, watch
from pricetide.sources import feeds, pages, watchlist
from pricetide.streaming import jobs

LISTING = "store_id string, sku string, raw_title string, platform string, region string, game string"
# Titles, the console stored with them, and the product they must end up in.
TITLES = [
    ("Sega Sonic Forces: Standard Edition - Nintendo Switch", "SWITCH", "sonic forces"),
    ("Sonic Forces Nintendo Switch", "SWITCH", "sonic forces"),
    ("Sonik Forsez", "SWITCH", "sonic forces"),
    ("Maximum Games Alfred Hitchcock: Vertigo - Limited Edition (Nintendo Switch)", "SWITCH", "alfred hitchcock vertigo limited"),
    ("Alfred Hitchcock Vertigo Limited Edition Switch", "SWITCH", "alfred hitchcock vertigo limited"),
    ("Sega Genesis Classics", "SWITCH", "sega genesis classics"),
    ("FC 26 EA SPORTS Nintendo Switch", "SWITCH", "ea sports fc 26"),
    ("EA Sports FC 26 Nintendo Switch", "SWITCH", "ea sports fc 26"),
    ("EA Sports FC 26 - Nintendo Switch", "SWITCH", "ea sports fc 26"),
    ("Capcom vs SNK", "SWITCH", "capcom vs snk"),
    ("SNK vs Capcom", "SWITCH", "snk vs capcom"),
    ("Hogwarts Legacy", "UNKNOWN", None),
    ("Nintendo Switch Game (Asia)", "SWITCH", None),
]


@pytest.fixture(scope="module")
def assigned(spark):
    stored = [("s", str(i), t, p, "IN", "old sonic" if "Forces" in t else None) for i, (t, p, _) in enumerate(TITLES)]
    listing = spark.createDataFrame(stored, LISTING)
    aliases = spark.createDataFrame([("Sonik Forsez", "Sega Sonic Forces", 1)], "from_title string, to_title string, ord int")
    return matching.assign_games(listing, aliases).cache()


def test_assignment(assigned):
    got = {r.raw_title: r.game for r in assigned.collect()}
    assert got == {t: want for t, _, want in TITLES}


def test_the_titles_console_repairs_the_stored_one(spark):
    rows = [
        ("s", "1", "Xenoblade Chronicles™ X – Nintendo Switch™ 2 Edition", "SWITCH", "IN", None),
        ("s", "2", "NSW™, NSW2™ Tales of Vesperia", "SWITCH2", "IN", None),
        ("s", "3", "Hogwarts Legacy", "SWITCH2", "IN", None),
    ]
    got = matching.assign_games(spark.createDataFrame(rows, LISTING)).collect()
    assert {r.sku: r.platform for r in got} == {"1": "SWITCH2", "2": "SWITCH", "3": "SWITCH2"}


def test_redirects_follow_a_key_that_moved_whole(spark, assigned):
    old = spark.createDataFrame(
        [("ea sports fc 26", "SWITCH", "elsewhere"), ("kept", "SWITCH", "x")], "old_title string, platform string, new_title string"
    )
    got = {r.old_title: r.new_title for r in matching.game_redirects(assigned, old).collect()}
    assert got == {"old sonic": "sonic forces", "kept": "x"}


def test_split_keys_record_no_guess(spark):
    rows = [("s", "1", "Mario Kart World", "SWITCH", "IN", "old"), ("s", "2", "Donkey Kong Bananza", "SWITCH", "IN", "old")]
    assert matching.game_redirects(matching.assign_games(spark.createDataFrame(rows, LISTING))).count() == 0


def test_possible_splits_agree_with_comparing_all_pairs(spark):
    words = ["zelda", "ring", "fit", "dlc", "2", "mario", "kart", "divine", "gold", "party"]
    random.seed(5)
    names = sorted({" ".join(random.sample(words, random.randint(1, 5))) for _ in range(150)})
    rows = [("s", str(i), f"{n} Divine Edition" if i % 9 == 0 else n, "SWITCH", "IN", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, LISTING)
    from pricetide import vocab

    def variant(w):
        return w in vocab.VARIANT_WORDS or any(c.isdigit() for c in w)

    want = set()
    for i, long_key in enumerate(names):
        edition = i % 9 == 0
        for short in names:
            extra = set(long_key.split()) - set(short.split())
            if set(short.split()) < set(long_key.split()) and 1 <= len(extra) <= 2 and len(short.split()) >= 2:
                if not any(variant(w) or (edition and w == "divine") for w in extra):
                    want.add((short, long_key))
    got = {(r.short_key, r.long_key) for r in matching.subset_key_join(df).collect()}
    assert got == want


def test_possible_splits_of_long_keys(spark):
    """Sixty words: nothing is spelled out but the words."""
    words = ["".join("abcdefgh"[int(d)] for d in f"{i:03o}") for i in range(60)]
    keys = [words, words[:59], words[1:59], words[:57], words[:58] + ["zz"], words[:1], words[3:5], [*words[3:5], "yy"]]
    names = [" ".join(k) for k in keys]
    df = spark.createDataFrame([("s", str(i), n, "SWITCH", "IN", n) for i, n in enumerate(names)], LISTING)
    got = {(names.index(r.short_key), names.index(r.long_key)) for r in matching.subset_key_join(df).collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (3, 1), (3, 4), (6, 7)}


def test_redirect_chains_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("self", "self")]
    redirects = spark.createDataFrame([(o, "P", n) for o, n in pairs], "old_title string, platform string, new_title string")
    starts = spark.createDataFrame([(k, "P") for k in ("a", "d", "x", "in", "self", "none")], "key string, platform string")
    got = {r.key: r.resolved for r in watch.redirect_resolve(starts, redirects).collect()}
    assert got == {"a": "d", "d": "d", "x": "z", "in": "z", "self": "self", "none": "none"}


def test_watchlist_file_is_not_trusted(spark):
    entries = [
        {"game": "a", "platform": "SWITCH", "target": 4000}, {"game": "b", "platform": "SWITCH", "target": "4000"},
        {"game": "c", "platform": "SWITCH", "target": True}, {"game": "d", "platform": "SWITCH", "target": 0},
        {"game": "e", "platform": "SWITCH", "condition": "USED", "shops": "INDIA"}, {"game": "f"}, {"platform": "SWITCH"}, 7, "x",
        {"game": 5, "platform": "SWITCH"}, {"game": "g", "platform": "SWITCH", "target": 12.5, "condition": "NEW", "shops": 3},
    ]
    bodies = spark.createDataFrame([(json.dumps(entries),), ("{broken",), ('{"game":"z","platform":"S"}',), ("",)], "body string")
    got = {r.game: (r.target, r.condition, r.shops) for r in watchlist.read_watchlist(bodies).collect()}
    assert got == {
        "a": (4000.0, "ANY", "ALL"), "b": (None, "ANY", "ALL"), "c": (None, "ANY", "ALL"), "d": (None, "ANY", "ALL"),
        "e": (None, "ANY", "INDIA"), "g": (12.5, "NEW", "ALL"),
    }


def test_watch_changes_keep_what_they_do_not_name(spark):
    now = spark.createDataFrame(
        [("a", "S", 10.0, "NEW", "ALL", 0), ("a", "S", 99.0, "ANY", "ALL", 1), ("b", "S", 5.0, "ANY", "ALL", 2)],
        "game string, platform string, target double, condition string, shops string, position int",
    )
    changes = spark.createDataFrame(
        [("a", "S", 1, False, None, None, "INDIA"), ("b", "S", 2, True, None, None, None), ("n", "S", 3, True, 7.0, None, None)],
        "game string, platform string, ord int, set_target boolean, target double, condition string, shops string",
    )
    got = {r.game: (r.target, r.condition, r.shops) for r in watchlist.watchlist_upsert(now, changes).collect()}
    assert got == {"a": (10.0, "NEW", "INDIA"), "b": (None, "ANY", "ALL"), "n": (7.0, "ANY", "ALL")}


def test_one_product_per_sku(spark):
    rows = [("s", 1, "CG", "101"), ("s", 2, "CG", "102"), ("s", 3, "MK8", "103"), ("s", 4, "MK8", "103"), ("t", 1, "CG", "9")]
    df = spark.createDataFrame(rows, "store_id string, pos int, sku string, product_id string")
    got = sorted((r.store_id, r.sku, r.pos) for r in dedupe.one_product_per_sku(df, ["pos"]).collect())
    assert got == [("s", "101", 1), ("s", "102", 2), ("s", "MK8", 3), ("t", "CG", 1)]


def test_page_walks_agree_with_walking(spark):
    random.seed(9)
    pages_, want = [], {}
    for w in range(60):
        streak, stop = 0, None
        for p in range(1, random.randint(2, 25)):
            raw = random.choice([0, 20, 20, 20, 20, 20])
            kept = random.choice([0, 10, 20]) if raw else 0
            new = min(kept, random.choice([0, 1, 1, 2, 8]))
            pages_.append((w, p, raw, kept, new))
            if stop is None:
                total = kept or raw
                streak = streak + 1 if raw and (new == 0 or new / total < 0.15) else 0
                stop = p if raw == 0 or streak >= 4 else None
        want[w] = stop or pages_[-1][1]
    df = spark.createDataFrame(pages_, "w int, page int, raw_rows int, kept_rows int, new_rows int")
    assert {r.w: r.stop_page for r in dedupe.productivity_streak(df, ["w"]).collect()} == want


LD = '<script type="application/ld+json">{}</script>'


def test_json_ld(spark):
    graph = {"@graph": [{"@type": "WebSite", "name": "shop"}, {"@type": ["Thing", "Product"], "name": "Pikmin", "url": "/p/4", "offers": {"price": "3,999"}}]}
    listed = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "Zelda", "url": "/p/2",
              "offers": [{"lowPrice": 4299, "availability": "Out Of Stock"}]}}, {"item": {"@type": "Product", "name": "No link", "offers": {"price": 1}}}]}
    html = LD.format("{broken") + LD.format(json.dumps(graph)) + "<script>var x = 1</script>" + LD.format(json.dumps(listed))
    df = spark.createDataFrame([("p", "s", html), ("q", "s", "<html></html>")], "page_id string, store_id string, html string")
    got = sorted((r.title, r.price, r.href, r.in_stock) for r in pages.jsonld_products(df).collect())
    assert got == [("Pikmin", 3999.0, "/p/4", True), ("Zelda", 4299.0, "/p/2", False)]


def test_embedded_state(spark):
    node = {"productTitle": "Deep", "finalPrice": {"value": 7}, "url": "/d", "availability": {"intent": "OUT_OF_STOCK"}}
    far = node | {"productTitle": "Far"}
    for _ in range(60):
        far = {"x": far}
    state = {"a": [node, {"title": "No number", "price": {"value": "7"}, "url": "/n"}], "far": far}
    html = f"<script>window.__INITIAL_STATE__ = {json.dumps(state)};</script>"
    df = spark.createDataFrame([("p", "s", html)], "page_id string, store_id string, html string")
    assert [(r.title, r.price, r.href, r.in_stock) for r in pages.embedded_state(df).collect()] == [
        ("Deep", 7.0, "/d", False), ("Far", 7.0, "/d", False),
    ]


def test_shopify_feed(spark):
    def product(i, title, **variant):
        return {"id": i, "title": title, "handle": f"h{i}", "product_type": "Nintendo Switch Games", "tags": ["SWITCH OLED"],
                "variants": [{"price": "Rs. 4,499", **variant}] if variant is not None else [], "images": []}

    items = [product(1, "Hogwarts Legacy", sku=" K "), product(2, "Mario Kart", sku="", available=False), product(3, "Pro Controller", sku="P"),
             product(4, "No price", price="ask"), {**product(5, "No variant"), "variants": []}, product(6, "Zelda (Used)", sku="K")]
    payload = spark.createDataFrame([("s", 1, json.dumps({"products": items})), ("s", 2, "<html>")], "store_id string, page int, body string")
    shop = spark.createDataFrame([("s", "https://s.in", "INR", None)], "store_id string, base_url string, currency string, platform_hint string")
    got = sorted((r.sku, r.title, r.in_stock, r.native_price, r.url) for r in feeds.shopify_listings(payload, shop).collect())
    assert got == [
        ("1", "Hogwarts Legacy", True, 4499.0, "https://s.in/products/h1"),
        ("2", "Mario Kart", False, 4499.0, "https://s.in/products/h2"),
        ("6", "Zelda (Used)", True, 4499.0, "https://s.in/products/h6"),
    ]


def test_a_stream_of_late_points_ends_where_the_batch_does(spark, tmp_path):
    rows = [("a", str(i % 7), i, i % 11, float(i)) for i in range(200)]
    random.Random(3).shuffle(rows)
    columns = "store_id string, sku string, point_id long, captured_at long, inr_price double"
    df = spark.createDataFrame(rows, columns)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_increments(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    job = jobs.latest_price_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    job.awaitTermination()
    from pricetide.operators.history import latest_and_previous

    def plain(frame):
        return sorted((r.sku, r.inr_price, r.previous.inr_price) for r in frame.collect())

    assert plain(jobs.read_latest_price(spark, str(tmp_path / "out"))) == plain(latest_and_previous(df))
    # a table per batch, until there are enough to put together
    assert sorted(f.name for f in (tmp_path / "out").glob("upto=*")) == [f"upto={i}" for i in range(4)]
    # a restart without new data leaves the state where it was
    again = jobs.latest_price_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    again.awaitTermination()
    assert plain(jobs.read_latest_price(spark, str(tmp_path / "out"))) == plain(latest_and_previous(df))
