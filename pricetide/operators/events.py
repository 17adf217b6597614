"""The progress log of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.operators.common import count_where

EVENT_COLUMNS = ["seq", "run_id", "event_at", "kind", "store_id", "status", "count", "page", "duration_ms", "detail"]


def events_since(events: DataFrame, run_id: object, after_seq: int) -> DataFrame:
    """One run's events after a cursor, oldest first."""
    return events.where((F.col("run_id") == run_id) & (F.col("seq") > after_seq)).orderBy("seq").select(*EVENT_COLUMNS)


def events_after_cursors(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """The same for many readers at once: ``cursors`` has (run_id, after_seq)."""
    return events.join(cursors, "run_id").where(F.col("seq") > F.col("after_seq")).select(*EVENT_COLUMNS, "after_seq")


def run_finished_flag(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.max(F.col("kind") == "run_finished").alias("finished"))


def run_progress(events: DataFrame) -> DataFrame:
    """State of each run: stores done, failed or skipped, listings so far, where it is now.

    Plain partial aggregates, so the same expression serves a batch and a
    stream, in whatever order events arrive.
    """
    finished = F.col("kind") == "store_finished"
    started, paged = F.col("kind") == "store_started", F.col("kind") == "store_progress"
    here = F.struct("seq", "store_id", F.when(paged, F.col("page")).otherwise(0).alias("page"))
    at = F.max(F.when(started | paged, here))
    return events.groupBy("run_id").agg(
        F.max(F.when(F.col("kind") == "run_started", F.struct("seq", "count")))["count"].alias("total"),
        count_where(finished).alias("done"),
        count_where(finished & F.col("status").isin("failed", "skipped")).alias("failed"),
        F.coalesce(F.sum(F.when(finished, F.col("count"))), F.lit(0)).alias("listings"),
        at["store_id"].alias("current_store"),
        at["page"].alias("current_page"),
        F.max("seq").alias("last_seq"),
    )


def store_progress(events: DataFrame) -> DataFrame:
    """The same per run and store: newest count and deepest page."""
    return events.where(F.col("store_id").isNotNull()).groupBy("run_id", "store_id").agg(
        F.max(F.when(F.col("count").isNotNull(), F.struct("seq", "count")))["count"].alias("listings"),
        F.max("page").alias("page"),
        F.max(F.when(F.col("status").isNotNull(), F.struct("seq", "status")))["status"].alias("status"),
        F.max("seq").alias("last_seq"),
    )


def fold_run_events(reports: DataFrame) -> DataFrame:
    """Progress reports as log rows: each kind carries only its own fields.

    ``reports`` has the log columns, any of them filled.
    """
    kind = F.col("kind")

    def only(column: str, *kinds: str):
        return F.when(kind.isin(*kinds), F.col(column)).alias(column)

    return reports.where(
        kind.isin("run_started", "store_started", "store_progress", "store_finished", "run_finished", "warning")
    ).select(
        "seq",
        "run_id",
        "event_at",
        "kind",
        only("store_id", "store_started", "store_progress", "store_finished", "warning"),
        only("status", "store_finished"),
        only("count", "run_started", "store_progress", "store_finished"),
        only("page", "store_progress"),
        only("duration_ms", "store_finished"),
        only("detail", "store_started", "store_finished", "run_finished", "warning"),
    )


def append_run_events(events: DataFrame, path: str) -> None:
    """Append to the log, one folder per run."""
    events.hint("rebalance", F.col("run_id")).write.mode("append").partitionBy("run_id").parquet(path)
