"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of Parquet tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores                (default 8)

The logical tables are derived from the given ones and stored first, as a
collector would have left them; that takes ``landing_sec``.  Every query then
runs twice over the whole stored tables and its faster run counts, so that
class loading and compilation are not what is measured.  ``kept_state_sec`` is
what building the two newest points and the price record of each listing took,
which the queries named ``..._kept`` read.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pricetide import build_session  # noqa: E402
from pricetide.plans import catalog  # noqa: E402
from pricetide.plans.views import Bound  # noqa: E402
from pricetide.session import release, work_dir  # noqa: E402

HEADLINE = [
    "nth_latest", "movers", "games_best_offer", "assign_games", "listings_page", "games_page", "history_stats",
    "listings_page_kept", "movers_kept", "lowest_ever", "lowest_ever_kept", "history_stats_kept", "facets_self_excluding", "audit_per_store", "fx_asof", "match_key", "watch_status", "run_progress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    tables = Bound(spark, folder).landed(work_dir(spark, "tables"))
    landing = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    tables.keep_latest(work_dir(spark, "kept"))
    tables.keep_record(work_dir(spark, "record"))
    kept = round(time.perf_counter() - start, 3)
    builds, took = catalog.builds(), {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):
            release()  # nothing of the run before is read again
            start = time.perf_counter()
            builds[name](tables).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        took[name] = min(runs)
        print(name, runs, file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": folder,
                "landing_sec": landing, "kept_state_sec": kept,
            }
        )
    )


if __name__ == "__main__":
    main()
