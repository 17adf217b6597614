"""The registered queries: complete, stable, and equal to their SQL where that is quick to check."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import compare, connect  # noqa: E402
from pricetide.plans import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "nth_latest", "movers", "movers_kept", "games_page", "facets_self_excluding", "productivity_streak", "one_product_per_sku", "fx_asof",
    "src_custom_feed", "rejected_elements", "select_stores", "summary", "health", "category_low", "html_unescape", "redirect_resolve",
    "listings_page_kept", "listings_page_price_desc", "game_offers_page", "watch_status", "rematch_preview", "stream_latest_price",
    "stream_new_hits",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert "best_price" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    text, good = compare(spark, connect(FOLDER), FOLDER, name, contract.queries()[name], contract.oracle_sql()[name])
    assert good, text
