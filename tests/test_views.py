"""The views on a small shop: ties, missing prices, removed listings, currency moves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide import PriceTables
from pricetide.functions.titles import literal_contains
from pricetide.operators import audit, facets, history, listings, monitoring, movers, offers, paging, title_index, upserts
from pricetide.operators.fx import fx_asof
from pricetide.operators.listings import ListingQuery

STORE = "store_id string, name string, currency string, tier int, enabled boolean, ships_from_abroad boolean"
LISTING = """store_id string, sku string, url string, raw_title string, platform string, region string, condition string,
  image_url string, game string"""
POINT = """store_id string, sku string, point_id long, run_id long, captured_at timestamp, native_currency string,
  native_price double, inr_price double, fx_rate_date date, in_stock boolean"""
RUN_STORE = "run_id long, store_id string, status string, listings_found long, duration_ms long, detail string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def point(i, store, sku, run, price, stock=True, at=None, native=None, ccy="INR"):
    native = price if native is None else native
    return (store, sku, i, run, day(run if at is None else at), ccy, native, price, None, stock)


@pytest.fixture(scope="module")
def shop(spark):
    def listing(store, sku, title, game, platform="SWITCH", region="IN", condition="NEW"):
        return (store, sku, f"https://{store}/{sku}", title, platform, region, condition, None, game)

    return PriceTables(
        store=spark.createDataFrame(
            [("a", "Alpha", "INR", 1, True, False), ("b", "Beta", "INR", 2, True, False), ("c", "Far", "USD", 1, True, True)], STORE
        ),
        listing=spark.createDataFrame(
            [
                listing("a", "1", "Zelda Switch", "zelda"),
                listing("b", "1", "Zelda - used copy", "zelda", condition="PRE_OWNED"),
                listing("c", "1", "Zelda (Japan) import", "zelda", region="JP"),
                listing("a", "2", "Mario 100%", "mario", platform="SWITCH2"),
                listing("b", "2", "No price yet", None),
                listing("a", "3", "Gone...", "gone"),
                listing("b", "3", "Never rated", "unpriced"),
            ],
            LISTING,
        ),
        price_point=spark.createDataFrame(
            [
                point(1, "a", "1", 1, 4000.0), point(2, "a", "1", 2, 3000.0),
                point(3, "b", "1", 1, 2500.0), point(4, "b", "1", 2, 1000.0, stock=False),
                point(5, "c", "1", 2, 2000.0),
                # Two points of one moment: the later id is the newer one.
                point(6, "a", "2", 2, 500.0, at=2), point(7, "a", "2", 2, 505.0, at=2),
                point(8, "a", "3", 1, 100.0),
                point(9, "b", "3", 1, None, native=9.0, ccy="XXX"), point(10, "b", "3", 2, None, native=9.0, ccy="XXX"),
            ],
            POINT,
        ),
        run=spark.createDataFrame(
            [(1, day(1), day(1)), (2, day(2), None)], "run_id long, started_at timestamp, finished_at timestamp"
        ),
        run_store=spark.createDataFrame(
            [(1, "a", "ok", 3, 5, None), (1, "b", "ok", 2, 5, None), (2, "a", "ok", 2, 5, None), (2, "b", "partial", 1, 5, "x"),
             (2, "c", "failed", 0, 5, "y")],
            RUN_STORE,
        ),
    )


def test_latest_takes_the_later_id_of_a_tie(shop):
    rows = {(r.store_id, r.sku): r for r in history.latest_and_previous(shop.price_point).collect()}
    assert rows["a", "2"].inr_price == 505.0 and rows["a", "2"].previous.inr_price == 500.0
    assert rows["c", "1"].previous is None


def test_only_a_later_ok_run_takes_a_listing_off_sale(shop):
    rows = history.with_buyable(history.nth_latest(shop.price_point), shop.run_store).collect()
    buyable = {(r.store_id, r.sku): r.buyable for r in rows}
    # a/3 is missing from a later ok run; b/3's later run was partial and c has no ok run at all.
    assert buyable == {("a", "1"): True, ("b", "1"): False, ("c", "1"): True, ("a", "2"): True, ("a", "3"): False, ("b", "3"): True}


def test_best_offer_prefers_what_can_be_bought(shop):
    rows = {r.game: r for r in offers.games_view(shop).collect()}
    zelda = rows["zelda"]
    assert (zelda.best_price, zelda.best_store, zelda.offers, zelda.stores) == (2000.0, "Far", 3, 3)
    assert zelda.title == "Zelda Switch" and zelda.lowest_ever == 1000.0 and zelda.at_lowest is False
    assert rows["gone"].best_in_stock is False and rows["gone"].best_price == 100.0
    # Only unpriced offers: counted, shown without a price, sorted last in both directions.
    assert rows["unpriced"].best_price is None and rows["unpriced"].offers == 1
    for direction in ("asc", "desc"):
        assert offers.games_page(shop, ListingQuery(direction=direction)).collect()[-1].game == "unpriced"


def test_lowest_ever_is_narrowed_by_condition_and_origin_only(shop):
    narrow = ListingQuery(condition="NEW", domestic_only=True, regions=("IN",), q="zelda")
    row = offers.games_view(shop, narrow).collect()
    assert [(r.game, r.best_price, r.lowest_ever, r.runs_seen, r.at_lowest) for r in row] == [("zelda", 3000.0, 3000.0, 2, True)]


def test_listing_filters_agree_with_brute_force(shop):
    base = {(r.store_id, r.sku): r for r in listings.priced_listings(shop).collect()}
    tests = {
        "platform": (ListingQuery(platform="SWITCH2"), lambda r: r.platform == "SWITCH2"),
        "stores": (ListingQuery(stores=("a", "c")), lambda r: r.store_id in "ac"),
        "stock": (ListingQuery(in_stock_only=True), lambda r: r.buyable),
        "game": (ListingQuery(game="zelda"), lambda r: r.game == "zelda"),
        "percent": (ListingQuery(q="%"), lambda r: "%" in r.raw_title),
        "all": (ListingQuery(), lambda r: True),
    }
    for query, keep in tests.values():
        got = {(r.store_id, r.sku) for r in listings.matching_listings(shop, query).collect()}
        assert got == {k for k, r in base.items() if keep(r)}
        assert listings.listings_total(shop, query).first().total == len(got)
    assert [r.sku for r in listings.listings_page(shop, ListingQuery(sort="change")).collect()] == ["1", "1"]
    assert listings.listings_page(shop, ListingQuery(offset=100)).count() == 0


def test_movers_report_raw_stock_and_skip_small_or_unpriced_moves(shop):
    rows = movers.movers(shop).collect()
    assert [(r.store_id, r.sku, r.pct, r.in_stock) for r in rows] == [("b", "1", -60.0, False), ("a", "1", -25.0, True)]


def test_a_synchronised_move_of_a_currency_is_suspect(spark, shop):
    points, rows = [], []
    for i in range(8):
        for ccy in ("USD", "INR"):
            sku = f"{ccy}{i}"
            rows.append(("a", sku, "u", "t", "SWITCH", "IN", "NEW", None, None))
            points += [point(2 * i, "a", sku, 1, 100.0, ccy=ccy), point(2 * i + 1, "a", sku, 2, 90.0, ccy=ccy)]
    points += [point(1, "a", "alone", 1, 100.0, ccy="USD"), point(2, "a", "alone", 2, 70.0, ccy="USD")]
    rows.append(("a", "alone", "u", "t", "SWITCH", "IN", "NEW", None, None))
    t = shop.with_(listing=spark.createDataFrame(rows, LISTING), price_point=spark.createDataFrame(points, POINT))
    suspect = {r.sku: r.fx_suspect for r in movers.movers(t).collect()}
    assert all(suspect[f"USD{i}"] and not suspect[f"INR{i}"] for i in range(8)) and not suspect["alone"]
    # 8 rupee moves and the lone one are drops of the shops' own.
    assert monitoring.summary(t).first().price_drops == 9


def test_facets_count_unpriced_listings_and_keep_empty_values(shop):
    plain = {(r.facet, r.value): r.n for r in facets.facets(shop).collect()}
    assert plain["stores", "b"] == 3 and plain["regions", "JP"] == 1
    got = facets.facets_self_excluding(shop, ListingQuery(stores=("a",), regions=("JP",), in_stock_only=True))
    narrowed = {(r.facet, r.value): r.n for r in got.collect()}
    assert (narrowed["stores", "a"], narrowed["stores", "c"], narrowed["regions", "IN"]) == (0, 1, 2)


def test_health_and_history_of_runs(shop):
    assert [r.store_id for r in monitoring.health(shop).collect()] == ["a", "c", "b"]
    assert [r.store_id for r in monitoring.health_by_severity(shop).collect()] == ["c", "b", "a"]
    later = shop.with_(run=shop.run.unionByName(shop.run.limit(1).withColumn("run_id", F.lit(9).cast("long"))))
    assert monitoring.health(later).count() == 0
    assert monitoring.last_successful_run(shop.run, shop.run_store).first()[0] == day(1)


def test_slot_due(spark, shop):
    run = spark.createDataFrame([(1, day(0), day(1).replace(hour=8))], "run_id long, started_at timestamp, finished_at timestamp")
    moments = spark.createDataFrame(
        [(day(1).replace(hour=7),), (day(1).replace(hour=7, minute=30),), (day(1).replace(hour=9),), (day(2).replace(hour=8),)], "moment timestamp"
    )
    got = monitoring.slot_due(moments, run, shop.run_store, "07:30").orderBy("moment").collect()
    assert [r.due for r in got] == [True, True, False, True]


def test_audit(shop):
    rows = {r.store_id: r for r in audit.audit_per_store(shop).collect()}
    # a/3 is cut, but the store no longer shows it.
    assert (rows["a"].cut_titles, rows["a"].bad_prices, rows["b"].no_rupee_price, rows["b"].ungrouped) == (0, 0, 1, 1)
    assert audit.audit_verdict(audit.audit_per_store(shop)).first().ok is True


def test_upsert_keeps_the_first_image_and_the_newest_text(spark):
    columns = "store_id string, sku string, point_id long, captured_at timestamp, url string, raw_title string, platform string, region string, condition string, image_url string"
    seen = spark.createDataFrame(
        [("a", "1", 1, day(1), "u1", "t1", "SWITCH", "IN", "NEW", None), ("a", "1", 2, day(2), "u2", "t2", "SWITCH", "IN", "NEW", "late.png")], columns
    )
    row = upserts.listing_upsert(seen, ["captured_at", "point_id"]).first()
    assert (row.url, row.raw_title, row.image_url, row.first_seen, row.last_seen) == ("u2", "t2", None, day(1), day(2))


def test_rates_are_taken_as_of_the_day(spark):
    rates = spark.createDataFrame(
        [("USD", "INR", 90.0, day(1).date()), ("USD", "INR", 95.7, day(3).date())], "base string, quote string, rate double, rate_date date"
    )
    seen = spark.createDataFrame(
        [(1, "USD", 59.99, day(0)), (2, "USD", 59.99, day(2)), (3, "USD", 59.99, day(3)), (4, "INR", 10.0, day(0)), (5, "JPY", 10.0, day(9))],
        "i int, native_currency string, native_price double, captured_at timestamp",
    )
    got = {r.i: (r.inr_price, r.fx_rate_date) for r in upserts.price_points(seen, rates).collect()}
    assert got == {1: (None, None), 2: (5399.1, day(1).date()), 3: (5741.04, day(3).date()), 4: (10.0, day(0).date()), 5: (None, None)}
    assert fx_asof(seen, rates).count() == 5


def test_history_is_cut_before_the_exchange(shop):
    """However long one listing's history is, a map task sends at most two of its points."""
    plan = history.latest_and_previous(shop.price_point)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below and plan.count("Exchange") == 1


def test_history_stats_keep_the_earliest_of_equal_prices(spark):
    points = spark.createDataFrame([point(i, "a", "1", i, p) for i, p in enumerate([5.0, 3.0, 9.0, 3.0, 9.0, None, 4.0])], POINT)
    row = history.history_stats(points).first()
    assert (row.now_price, row.low_price, row.low_at, row.high_price, row.high_at, row.n_prices, row.since) == (
        4.0, 3.0, day(1), 9.0, day(2), 6, day(0),
    )


def test_pages_join_without_gap_or_repeat(spark, shop):
    """Cursor after cursor, in every order and direction, over ties, NULLs and unpriced listings."""
    extra = [(f"t{i}", "x", f"https://x/{i}", "Tie" if i % 3 else None, "SWITCH", "IN", "NEW", None, f"g{i % 4}") for i in range(12)]
    listing = shop.listing.unionByName(spark.createDataFrame([(s[0], s[0], *s[2:]) for s in extra], LISTING).withColumn("store_id", F.lit("a")))
    more = [point(100 + i, "a", f"t{i}", r, [7.0, None, 7.5, 9.0][i % 4] if r == 2 else 7.0) for i in range(12) for r in (1, 2)]
    t = shop.with_(listing=listing, price_point=shop.price_point.unionByName(spark.createDataFrame(more, POINT)))
    for sort in ("price", "title", "store", "seen", "change"):
        for direction in ("asc", "desc"):
            q = ListingQuery(sort=sort, direction=direction, limit=1000)
            whole = [tuple(r) for r in listings.listings_page(t, q).collect()]
            got, at = [], None
            for _ in range(len(whole) // 7 + 2):
                rows = listings.listings_page(t, ListingQuery(sort=sort, direction=direction, limit=7, after=at)).collect()
                got += [tuple(r) for r in rows]
                at = listings.listings_cursor(q, rows[-1]) if rows else at
            assert got == whole and len(whole) > 2
    for sort in ("price", "title", "offers"):
        for direction in ("asc", "desc"):
            q = ListingQuery(sort=sort, direction=direction, limit=1000)
            whole = [tuple(r) for r in offers.games_page(t, q).collect()]
            got, at = [], None
            for _ in range(len(whole) // 3 + 2):
                one = offers.games_page(t, ListingQuery(sort=sort, direction=direction, limit=3, after=at))
                rows = one.select("*", paging.cursor_of(offers.games_order(q)).alias("c")).collect()
                got += [tuple(r)[:-1] for r in rows]
                at = tuple(rows[-1].c) if rows else at
            assert got == whole


def test_a_cursor_filters_before_the_sort(shop):
    q = ListingQuery(limit=5, after=(3000.0, "a", "1"))
    plan = listings.listings_page(shop, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "3000.0" in plan
    with pytest.raises(ValueError):
        listings.listings_page(shop, ListingQuery(after=(1.0,)))


def test_search_reads_postings_of_rare_pieces(spark, tmp_path):
    titles = [f"Switch game {i % 50} {w}" for i in range(300) for w in ("zelda", "mario", "Ünïque")]
    titles += ["Rarest zebra", "100% legit_name", "ab", "", None, "İstanbul zebra", "aaaa", "SWITCH\\game"]
    rows = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(titles)], "store_id string, sku string, raw_title string")
    index = title_index.build(rows, str(tmp_path), 4)
    for term in ("zebra", "ZEBRA", "switch", "game 49", "ünïque", "100% l", "legit_", "ab", "a", "", "zzz", "aaa", "aaaa", "aaaaa", "h\\g", "switch game 7 mario", "istanbul", "İSTANBUL"):
        want = sorted(r.sku for r in rows.where(literal_contains(F.col("raw_title"), term)).collect())
        assert sorted(r.sku for r in title_index.search(rows, index, term).collect()) == want, term
    common = {r.piece for r in index.counts.where("not listed").collect()}
    assert "swi" in common and index.postings.where(F.col("piece").isin(*common)).count() == 0
    assert title_index.rarest(index, "zebra") and title_index.rarest(index, "switch") is None and title_index.rarest(index, "zzz") == []
    plan = title_index.search(rows, index, "zebra")._jdf.queryExecution().executedPlan().toString()
    assert "In(piece, [bra,ebr,zeb])" in plan.replace(", ", ",").replace("In(piece,", "In(piece, ")
