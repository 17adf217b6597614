"""What the queries on listings, offers and runs may not have in their plans, and that asking for one runs nothing."""

from pathlib import Path

import pytest

from pricetide.plans import catalog
from pricetide.plans.views import Bound
from pricetide.session import release

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")

PAGED = ["listings_page", "listings_page_kept", "games_page", "movers_page", "game_offers", "game_offers_page"]
NAMES = [
    "nth_latest", "listing_filter", "domestic_only", "movers", "movers_kept", "mover_store_filter", "price_history", "history_stats",
    "games_best_offer", "lowest_ever", "lowest_ever_kept", "history_stats_kept", "literal_contains", "price_note", "at_lowest", "facets", "facets_self_excluding", "summary", "select_stores", "category_low",
    "productivity_streak", "completeness", "audit_per_store", "fx_asof", "one_product_per_sku", *PAGED,
]


@pytest.fixture(scope="module")
def plans(spark):
    tables = Bound(spark, FOLDER)
    for name in ("lineitem", "supplier", "part", "nation", "orders", "events"):
        tables.view(name)  # reading a footer for its schema is a job
    spark.sparkContext.setJobGroup("building", "plans only")
    found = {name: catalog.builds()[name](tables) for name in NAMES}
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    texts = {name: df._jdf.queryExecution().sparkPlan().toString() for name, df in found.items()}
    release()
    return texts, list(ran)


def test_building_runs_nothing(plans):
    assert plans[1] == []


def test_no_nested_loops_and_no_products(plans):
    assert [n for n, p in plans[0].items() if "NestedLoop" in p or "Cartesian" in p] == []


def test_total_order_only_for_pages(plans):
    assert [n for n, p in plans[0].items() if "rangepartitioning" in p and n not in PAGED] == []
