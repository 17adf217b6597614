"""What grows with the tables is made once, and in many tasks."""

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from pricetide import session
from pricetide.functions.regex import any_of
from pricetide.operators import listings, matching, offers, title_index, watch
from pricetide.operators.listings import ListingQuery
from pricetide.plans import watch_queries
from pricetide.plans.views import Bound
from pricetide.sources import pages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_share_the_test_for_a_word_boundary(rows):
    sources = (r"\bab", r"\bcd\b", r"e[|)]", r"\bf|g", r"\b?h")
    shared = any_of(sources)
    assert shared.startswith(r"(?iUd)(?:\b(?:ab|cd\b)|")
    texts = rows([(t,) for t in ("ab", "xab", "x AB", "cd", "cde", "xcd", "e|", "xe)", "xf", "f", "xg", "xh", "")], "t string")
    plain = "(?iUd)(?:" + "|".join(sources) + ")"
    assert texts.where(F.col("t").rlike(shared) != F.col("t").rlike(plain)).isEmpty()


def test_pieces_read_a_text_once(rows):
    made = rows([("Añb\n\U0001f3aeC", "d")], "a string, b string").select(title_index.pieces(F.concat("a", "b")).alias("p"))
    assert made.first().p == ["añb", "ñb\n", "b\n\U0001f3ae", "\n\U0001f3aec", "\U0001f3aecd"]
    assert plan(made).count("lambda") == 0
    short = rows([("ab",), ("",), (None,)], "t string").select(title_index.pieces(F.col("t")).alias("p"))
    assert [r.p for r in short.collect()] == [[], [], None]


def test_redirects_read_the_listings_once(rows):
    assigned = rows([("old", "S", "new", "S"), ("kept", "S", "kept", "S")], "stored_game string, stored_platform string, game string, platform string")
    moved = matching.game_redirects(assigned)
    assert plan(moved).count("InMemoryRelation") == 2
    assert [tuple(r) for r in moved.collect()] == [("old", "S", "new")]


def test_sorted_watches_are_held(rows):
    status = rows([("b", "S", None, False), ("a", "S", "t", True)], "game string, platform string, title string, hit boolean")
    ordered = watch.watch_sort(status)
    assert "InMemoryRelation" in plan(ordered) and [r.game for r in ordered.collect()] == ["a", "b"]


def test_increments_are_many_files(spark):
    class Bound:
        buckets = 8

    Bound.spark = spark
    path, files = watch_queries._landed(Bound, spark.range(1000), 3)
    landed = spark.read.parquet(path)
    assert files == 3 and len(landed.inputFiles()) == 9 and landed.distinct().count() == 1000


def test_a_page_of_a_view_at_hand(rows):
    view = rows([("b", "S", 2.0, True), ("a", "S", 1.0, True)], "game string, platform string, best_price double, best_in_stock boolean")
    assert [r.game for r in offers.games_page(None, view=view).collect()] == ["a", "b"]


def _given(spark, path):
    lines = [(o, 1 + o % 3, 1 + o % 2, 1, 2.0, 100.0 + o, "NR"[o % 2]) for o in range(1, 13)] + [(13, None, 1, 1, 1.0, 5.0, "N"), (14, 7, None, 1, 1.0, 5.0, "N")]
    given = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
        .withColumn("l_shipdate", F.expr("make_timestamp_ntz(2020, 1, CAST(l_orderkey AS INT), 0, 0, 0)")),
        "part": spark.createDataFrame([(1, "old cup"), (2, "new cup"), (2, "new cup again")], "p_partkey long, p_name string").selectExpr("*", "1 AS p_size", "1e0 AS p_retailprice"),
        "supplier": spark.createDataFrame([(1, "one", 0), (2, "two", 1), (2, "two", 1)], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": spark.createDataFrame([(0, 0), (1, 3)], "n_nationkey long, n_regionkey long"),
        "orders": spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp_ntz"),
        "events": spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    }
    for name, df in given.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return Bound(spark, str(path))


def test_stored_tables_have_the_rows_of_their_views(spark, tmp_path):
    tables = _given(spark, tmp_path)
    for name in ("listing", "price_point", "run_store", "store"):
        kept, view = getattr(tables.stored_tables, name), getattr(tables, name)
        assert kept.dtypes == view.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, view.collect()))


def test_stored_shops_have_a_size(spark, tmp_path):
    """A page plans its join with shops by it, and moves no listing."""
    kept = _given(spark, tmp_path).stored_tables
    assert all("/stored-" in f for f in kept.store.inputFiles())
    page = listings.listings_page(kept, ListingQuery(sort="title"))
    assert "Exchange hashpartitioning" not in page._jdf.queryExecution().executedPlan().toString()


def test_watched_points_serve_ranking_and_record(spark, tmp_path):
    session.release()
    status = watch.watch_status(_given(spark, tmp_path).tables)
    held = [set(df.columns) for df in session._held]
    assert held.count(set(watch._POINT)) == 1 and status.count() == 3
    session.release()


def test_an_offer_is_carried_once(rows):
    made = [(c, 1, i, abroad, p, p < 9, c) for i, (c, abroad, p) in enumerate([("NEW", False, 5.0), (None, True, 3.0), ("USED", False, 4.0), ("NEW", True, 2.0), ("USED", False, 1.0)])]
    offers_ = rows([("g", "S", *m, "u", "r", "s") for m in made], "game string, platform string, condition string, store_id long, sku long, ships_from_abroad boolean, inr_price double, buyable boolean, c string, url string, region string, store string").drop("c")
    best = watch.best_by_variant(offers_)
    assert "least(" in plan(best)
    got = {(r.watch_condition, r.shops): (r.best.inr_price, r.offers) for r in best.collect()}
    assert got == {("ANY", "ALL"): (1.0, 5), ("ANY", "INDIA"): (1.0, 3), ("NEW", "ALL"): (2.0, 2), ("NEW", "INDIA"): (5.0, 1)}


def test_states_are_handed_over_as_arrow(rows):
    assert pages._find_state.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    product = '{"title":"%s","price":{"value":%s},"baseUrl":"u","availability":{"intent":"OUT_OF_STOCK"}}'
    nested = '{"x":[1,[' + product % ("a", 1) + ',null],{"y":' + product % ("b", "2.5") + "}]};"
    found = pages.embedded_state(rows([("p", 1, nested), ("q", 1, "7"), ("r", 1, "{"), ("s", 1, None)], "page_id string, store_id long, state string"))
    assert sorted((r.title, r.price, r.in_stock, r.position.i) for r in found.collect()) == [("a", 1.0, False, 0), ("b", 2.5, False, 1)]
