"""Price records and stored tables against the history, redirects of any length, appends and stream state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricetide import PriceTables
from pricetide.operators import history, listings, movers, offers, records, upserts, watch
from pricetide.operators.listings import ListingQuery
from pricetide.session import work_dir
from pricetide.sources import stored
from pricetide.streaming import jobs
from pricetide.streaming.levels import Levels, covered, live

POINT = """store_id string, sku string, point_id long, run_id long, captured_at timestamp, native_currency string,
  native_price double, inr_price double, fx_rate_date date, in_stock boolean"""


def points(seed, n=600, first=0):
    draw = random.Random(seed)
    day = dt.datetime(2026, 1, 1)
    return [
        (
            draw.choice("abc"), str(draw.randrange(12)), first + i, run, day + dt.timedelta(days=run), draw.choice(["INR", "USD"]), 1.0,
            draw.choice([None, 100.0, 200.0, 200.0, 50.0 + draw.randrange(9)]), None, draw.random() < 0.8,
        )
        for i, run in ((i, draw.choice([0, 1, 5, 63, 64, 65, 127, 128, 500])) for i in range(n))
    ]


def shop(spark, rows):
    listing = [
        (s, str(k), f"https://{s}/{k}", f"Title {k}", "SWITCH", "IN", "NEW" if k % 3 else "PRE_OWNED", None, f"game {k % 5}" if k else None)
        for s in "abc" for k in range(12)
    ]
    return PriceTables(
        store=spark.createDataFrame([(s, s.upper(), "INR", 1, True, s == "c") for s in "abc"],
                                    "store_id string, name string, currency string, tier int, enabled boolean, ships_from_abroad boolean"),
        listing=spark.createDataFrame(listing, """store_id string, sku string, url string, raw_title string, platform string,
          region string, condition string, image_url string, game string"""),
        price_point=spark.createDataFrame(rows, POINT),
        run_store=spark.createDataFrame([(r, s, "ok" if r % 2 else "failed") for r in (1, 63, 64) for s in "ab"], "run_id long, store_id string, status string"),
        watchlist=spark.createDataFrame(
            [(f"game {k}", "SWITCH", 300.0, c, s) for k in range(6) for c in ("ANY", "NEW") for s in ("ALL", "INDIA")],
            "game string, platform string, target double, condition string, shops string",
        ),
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_record_answers_what_the_history_does(spark):
    t = shop(spark, points(1))
    parts = [t.price_point.where(F.col("run_id") % 3 == i) for i in range(3)]
    whole = records.records(t.price_point)
    by_part = records.merged(records.records(parts[0]).union(records.records(parts[1])).union(records.records(parts[2])))
    assert rows_of(whole) == rows_of(by_part)
    kept = t.with_(record=by_part, price_point=None)
    assert rows_of(records.history_stats(by_part)) == rows_of(history.history_stats(t.price_point))
    plain = t.price_point.join(t.listing.where("game is not null"), ["store_id", "sku"]).groupBy("game", "platform")
    want = rows_of(plain.agg(F.min("inr_price"), F.count_distinct("run_id")))
    assert rows_of(offers.lowest_ever(t)) == rows_of(offers.lowest_ever(kept)) == want
    newest = history.two_newest(t.price_point)
    assert rows_of(watch.watch_status(t)) == rows_of(watch.watch_status(kept.with_(latest=newest)))


def test_record_of_odd_runs(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("a", "1", i, run, day, "INR", 1.0, price, None, True) for i, (run, price) in enumerate([(None, 5.0), (-1, None), (-64, 7.0), (2**40, None)])]
    t = shop(spark, rows)
    assert rows_of(offers.lowest_ever(t)) == [("game 1", "SWITCH", 5.0, 3)]
    assert records.records(t.price_point.limit(0)).count() == 0


def brute_watch(t):
    """Offers, shops, lowest price and runs of each watch, row by row."""
    latest = {(r.store_id, r.sku): r for r in history.nth_latest(t.price_point).collect()}
    abroad = {r.store_id: r.ships_from_abroad for r in t.store.collect()}
    seen = [r for r in t.price_point.collect()]
    out = []
    for w in t.watchlist.collect():
        mine = [
            r for r in t.listing.where(F.col("game") == w.game).collect()
            if (w.condition == "ANY" or r.condition == "NEW") and (w.shops == "ALL" or not abroad[r.store_id])
        ]
        keys = {(r.store_id, r.sku) for r in mine}
        offered = [k for k in keys if k in latest]
        history_ = [p for p in seen if (p.store_id, p.sku) in keys]
        prices = [p.inr_price for p in history_ if p.inr_price is not None]
        out.append((
            w.game, w.condition, w.shops, len(offered) or None, len({s for s, _ in offered}) or None,
            min(prices, default=None) if offered else None, len({p.run_id for p in history_}) if offered else None,
        ))
    return sorted(out, key=str)


def test_watch_status_counts(spark):
    t = shop(spark, points(4, n=60))
    status = watch.watch_status(t)
    assert rows_of(status.select("game", "condition", "shops", "offers", "stores", "lowest_ever", "runs_seen")) == brute_watch(t)
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def followed(pairs, key):
    seen = [key]
    while seen[-1] in pairs and pairs[seen[-1]] not in seen:
        seen.append(pairs[seen[-1]])
    return seen[-1]


def test_redirects_of_any_length(spark):
    """Short ones by steps, chains of thousands and circles by doubling; only asked keys come back."""
    pairs = {f"c{i}": f"c{i + 1}" for i in range(10_000)}
    pairs |= {"x": "y", "y": "x", "self": "self", "into": "x", "one": "two"}
    pairs |= {f"r{i}": f"r{(i + 1) % 40}" for i in range(40)} | {f"t{i}": f"t{i + 1}" for i in range(11)} | {"t11": "r7"}
    redirects = spark.createDataFrame([(a, "SWITCH", b) for a, b in pairs.items()], "old_title string, platform string, new_title string")
    asked = ["c0", "c5000", "c9995", "c10000", "x", "y", "self", "into", "one", "two", "nothing", "r3", "t0", "t9"]
    starts = spark.createDataFrame([(a, "SWITCH") for a in asked] * 2 + [("one", "PS5")], "key string, platform string")
    got = {(r.key, r.platform): r.resolved for r in watch.redirect_resolve(starts, redirects).collect()}
    assert got == {(a, "SWITCH"): followed(pairs, a) for a in asked} | {("one", "PS5"): "one"}
    short = watch.redirect_resolve(starts.where("key in ('one', 'x')"), redirects.where("old_title in ('one', 'x', 'y')"))
    assert rows_of(short) == [("one", "PS5", "one"), ("one", "SWITCH", "two"), ("x", "SWITCH", "y")]


def test_a_run_appended_twice_is_stored_once(spark):
    path = work_dir(spark, "points")
    rows = spark.createDataFrame(points(2), POINT)
    upserts.append_price_points(rows.where("run_id < 100"), path)
    upserts.append_price_points(rows.where("run_id >= 100"), path)
    upserts.append_price_points(rows.where("run_id = 64"), path)
    assert rows_of(spark.read.parquet(path).select(*rows.columns)) == rows_of(rows)


def exchanges(df):
    """What is exchanged by key in a plan, apart from what is broadcast."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if " Exchange " in line or line.startswith("Exchange ")]


def test_stored_tables_are_read_in_place(spark):
    t = shop(spark, points(3))
    path = work_dir(spark, "stored")
    stored.store_tables(t, path, 4)
    t.store.write.parquet(f"{path}/store")  # of a known size, as a landed table is
    t = t.with_(store=spark.read.parquet(f"{path}/store"))
    kept = stored.stored_tables(t, path, 4)
    for name in stored.LAYOUT:
        assert rows_of(getattr(kept, name)) == rows_of(getattr(t, name))
    latest = history.latest_and_previous(kept.price_point)
    page = listings.listings_page(kept, ListingQuery(sort="title"))
    assert exchanges(latest) == [] and exchanges(page) == []
    assert rows_of(latest.drop("previous")) == rows_of(history.nth_latest(t.price_point))
    assert rows_of(page) == rows_of(listings.listings_page(t, ListingQuery(sort="title")))
    moved = exchanges(movers.movers(kept))
    assert all("native_currency" in e for e in moved), moved  # what is counted by currency is, nothing by listing
    assert rows_of(movers.movers(kept)) == rows_of(movers.movers(t))


def test_levels_of_any_batch_hold_every_batch_once():
    for fan in (2, 3, 8):
        for batch in range(200):
            held = [b for table in live(batch, fan) for b in range(table, table - covered(table, fan), -1)]
            assert held == list(range(batch, -1, -1))
            assert len(live(batch, fan)) <= (fan - 1) * 9


def size(path):
    return sum(p.stat().st_size for p in path.rglob("part-*"))


def test_a_small_batch_writes_little(spark, tmp_path):
    """A batch of a hundredth of the listings writes a hundredth of the state; repeating it changes nothing."""
    state = jobs.latest_state(str(tmp_path))
    day = dt.datetime(2026, 1, 1)
    make = lambda skus, run: spark.createDataFrame(
        [("a", str(k), k * 1000 + run, run, day + dt.timedelta(days=run), "INR", 1.0, float(run), None, True) for k in skus], POINT
    )
    everything = make(range(20_000), 0).unionByName(make(range(20_000), 1))
    state.write(history.two_newest(everything), 0)
    small = make(range(0, 20_000, 100), 2)
    for _ in range(2):
        state.write(history.two_newest(small), 1)
        assert size(tmp_path / "upto=1") <= size(tmp_path / "upto=0") / 20
        want = rows_of(history.two_newest(everything.unionByName(small)))
        assert rows_of(state.read(spark)) == want


@pytest.mark.parametrize("fan", [2, 3])
def test_stream_state_equals_the_batch_after_every_batch(spark, tmp_path, fan):
    every = spark.createDataFrame([], POINT).coalesce(1)
    newest = Levels(str(tmp_path / "newest"), history.two_newest, fan)
    record = Levels(str(tmp_path / "record"), records.merged, fan)
    assert newest.last(spark) == -1
    for batch in range(9):
        some = spark.createDataFrame(points(batch, n=0 if batch == 2 else 40, first=1000 * batch), POINT).coalesce(1)
        every = every.unionByName(some)
        for _ in range(1 + batch % 2):  # every other batch is repeated
            newest.write(history.two_newest(some), batch)
            record.write(records.records(some), batch)
        if batch in (3, 7, 8):
            assert rows_of(newest.read(spark)) == rows_of(history.two_newest(every))
            assert rows_of(records.merged(record.read(spark))) == rows_of(records.records(every))
    assert newest.last(spark) == 8
    # what the last table took in goes with the next batch, everything before is gone
    left = {int(f.name.split("=")[1]) for f in (tmp_path / "newest").glob("upto=*")}
    assert left == {*live(8, fan), *(b for b in live(7, fan) if b > 8 - covered(8, fan))}


def test_announced_hits_carry_the_whole_record(spark, tmp_path):
    rows = points(6, n=300)
    t = shop(spark, rows).with_(redirect=None, aliases=None)
    source = str(tmp_path / "in")
    for part in (t.price_point.where("run_id < 64"), t.price_point.where("run_id >= 64")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_increments(spark, source, t.price_point.schema, files_per_batch=1)
    jobs.new_hits_stream(stream, t, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = jobs.read_new_hits(spark, str(tmp_path / "out"))
    assert found.count() > 0
    for batch, known in ((0, t.with_(price_point=t.price_point.where("run_id < 64"))), (1, t)):
        status = {(r.game, r.condition, r.shops): r for r in watch.watch_status(known).collect()}
        for r in found.where(F.col("batch") == batch).collect():
            same = status[r.game, r.condition, r.shops]
            assert (r.lowest_ever, r.runs_seen, r.at_lowest, r.best_price) == (same.lowest_ever, same.runs_seen, same.at_lowest, same.best_price)
