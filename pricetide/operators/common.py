"""Steps several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(order: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key, with their rank in ``rn``.

    The rank filter sits directly on the window, so each map task keeps at
    most ``n`` rows of a key before the exchange, however large the key is.
    """
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rn") <= n)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1).drop("rn")


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert semantics over a log: the newest row of each key."""
    return first_row(df, keys, newest(order))


def count_where(condition: Column) -> Column:
    """How many rows satisfy a condition; NULL does not count."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
