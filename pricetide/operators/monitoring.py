"""Runs: what was collected when, and how each store fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.operators.common import count_where, last_write, top_rows
from pricetide.operators.movers import movers
from pricetide.tables import PriceTables

SEVERITY = {"failed": 0, "skipped": 1, "partial": 2, "ok": 3}


def summary(t: PriceTables) -> DataFrame:
    """One row of headline numbers."""
    listing = t.listing.agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_distinct("store_id").alias("stores"),
        count_where(F.col("game").isNull()).alias("unmatched"),
    )
    points = t.price_point.agg(F.count(F.lit(1)).alias("points"))
    drops = movers(t).agg(count_where(F.col("is_deal")).alias("price_drops"))
    # Three one-row frames laid over one another.
    names = [*listing.columns, *points.columns, *drops.columns]
    rows = listing.unionByName(points, allowMissingColumns=True).unionByName(drops, allowMissingColumns=True)
    return rows.agg(*[F.max(n).alias(n) for n in names])


def has_ever_collected(run_store: DataFrame) -> DataFrame:
    """Whether any store was ever collected; reads one row."""
    return run_store.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_collected"))


def run_store_latest(log: DataFrame, order: list[str]) -> DataFrame:
    """One outcome per run and store: the last one written."""
    return last_write(log, ["run_id", "store_id"], order)


def health(t: PriceTables) -> DataFrame:
    """Stores of the latest run of any kind, by tier, then by listings found.

    Empty when the latest run was not a collection.
    """
    latest = t.run.agg(F.max_by(F.struct("run_id", "started_at", "finished_at"), "run_id").alias("r")).select("r.*")
    return (
        t.run_store.join(latest, "run_id")
        .join(t.store.select("store_id", "name", "tier"), "store_id")
        .select(
            "store_id", "name", "tier", "status", "listings_found", "duration_ms", "detail", "started_at", "finished_at"
        )
        .orderBy("tier", F.desc("listings_found"), "store_id")
    )


def _severity() -> Column:
    out = None
    for status, rank in SEVERITY.items():
        hit = F.col("status") == status
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(9)


def health_by_severity(t: PriceTables) -> DataFrame:
    """The same stores, those needing attention first."""
    return (
        health(t)
        .withColumn("severity", _severity())
        .withColumn("needs_attention", F.col("status").isin("failed", "skipped"))
        .orderBy("severity", F.desc("listings_found"), "store_id")
    )


def attention_count(t: PriceTables) -> DataFrame:
    return health(t).agg(
        F.count(F.lit(1)).alias("stores"),
        count_where(F.col("status").isin("failed", "skipped")).alias("need_attention"),
    )


def successful_runs(run: DataFrame, run_store: DataFrame) -> DataFrame:
    """Finished runs in which at least one store came back whole or in part."""
    good = run_store.where(F.col("status").isin("ok", "partial")).select("run_id")
    return run.where(F.col("finished_at").isNotNull()).join(good, "run_id", "left_semi")


def last_successful_run(run: DataFrame, run_store: DataFrame) -> DataFrame:
    return successful_runs(run, run_store).agg(F.max("finished_at").alias("last_finished"))


def latest_slot(now: Column, slot: str) -> Column:
    """The most recent moment a daily HH:MM slot fell due."""
    hour, minute = slot.split(":")
    today = F.date_trunc("day", now) + F.expr(f"INTERVAL '{int(hour)}:{int(minute)}' HOUR TO MINUTE")
    return F.when(today <= now, today).otherwise(today - F.expr("INTERVAL '1' DAY"))


def slot_due(moments: DataFrame, run: DataFrame, run_store: DataFrame, slot: str) -> DataFrame:
    """For each moment (column ``moment``): was the daily collection still to be done?

    Due unless a successful collection finished between the slot and the
    moment.  Finishes are put on the slot they satisfy, so this is one
    aggregation and one equi-join instead of a range join.
    """
    asked = moments.withColumn("slot_at", latest_slot(F.col("moment"), slot))
    done = (
        successful_runs(run, run_store)
        .groupBy(latest_slot(F.col("finished_at"), slot).alias("slot_at"))
        .agg(F.min("finished_at").alias("first_done"))
    )
    return (
        asked.join(done, "slot_at", "left")
        .withColumn("due", F.coalesce(F.col("first_done") > F.col("moment"), F.lit(True)))
        .select("moment", "slot_at", "due")
    )


def store_history(run: DataFrame, run_store: DataFrame, n: int = 5) -> DataFrame:
    """Each store's last ``n`` outcomes, newest first."""
    joined = run_store.join(run.select("run_id", "started_at"), "run_id")
    ranked = top_rows(joined, ["store_id"], [F.desc("started_at"), F.desc("run_id")], n)
    return ranked.select(
        "store_id", F.col("rn").alias("nth"), "started_at", "status", "listings_found", "detail"
    ).orderBy("store_id", "nth")


def completeness(fetches: DataFrame) -> DataFrame:
    """Status and reason of a fetch from how much of the shop's own total was seen.

    ``exact`` totals come from a feed's header and must be met; totals read
    off a page are best effort and may fall short by a tenth.
    Columns: kept, seen, claimed, exact, problems.
    """
    seen, claimed, problems = F.col("seen"), F.col("claimed"), F.col("problems")
    problem = F.coalesce(problems, F.lit("")) != ""
    counted = F.coalesce(claimed > 0, F.lit(False))
    note = F.when(
        counted & F.col("exact"), F.format_string(" (fetched %d of %d in category)", seen, claimed)
    ).when(counted, F.format_string(" (page claims about %d, %d rows seen)", claimed, seen)).otherwise("")
    short = counted & F.when(F.col("exact"), seen < claimed).otherwise(seen < claimed * vocab.CLAIMED_TOTAL_TOLERANCE)
    status = (
        F.when(F.col("kept") == 0, "failed").when(problem | short, "partial").otherwise("ok").alias("status")
    )
    reason = (
        F.when((F.col("kept") == 0) & ~problem, F.concat(F.lit("nothing extracted"), note))
        .when((F.col("kept") == 0) & F.col("exact"), problems)
        .when(problem, F.concat(problems, note))
        .when(short, F.concat(F.lit("stopped early"), note))
        .alias("reason")
    )
    return fetches.withColumn("outcome", F.struct(status, reason))
