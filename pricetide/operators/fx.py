"""Exchange rates as of an observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide import vocab


def fx_asof(observations: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``rate`` and ``rate_date``: the newest rate published on or before the observation's day.

    Home-currency rows get 1.0 on their own day, unknown currencies NULL.

    Observations only need to be matched per (currency, day), of which there
    are few, so the running "last rate" is computed over the distinct days and
    the fact table takes part in one equi-join on (currency, day) only.  A
    currency holding a third of all rows is one row per day here.
    """
    day = F.to_date("captured_at")
    seen = observations.where(F.col("native_currency") != vocab.HOME_CURRENCY)
    asked = seen.select(F.col("native_currency").alias("ccy"), day.alias("day")).distinct()
    published = rates.where(F.col("quote") == vocab.HOME_CURRENCY).select(
        F.col("base").alias("ccy"), F.col("rate_date").alias("day"), "rate"
    )
    timeline = published.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumn("asked", F.lit(True)), allowMissingColumns=True
    )
    window = (
        Window.partitionBy("ccy")
        .orderBy("day", "asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = F.when(~F.col("asked"), F.struct("rate", F.col("day").alias("rate_date")))
    answers = (
        timeline.withColumn("_fx", F.last(known, ignorenulls=True).over(window))
        .where("asked")
        .select(F.col("ccy").alias("native_currency"), F.col("day").alias("_day"), "_fx")
    )
    home = F.col("native_currency") == vocab.HOME_CURRENCY
    return (
        observations.withColumn("_day", day)
        .join(answers, ["native_currency", "_day"], "left")
        .withColumn("rate", F.when(home, 1.0).otherwise(F.col("_fx.rate")))
        .withColumn("rate_date", F.when(home, F.col("_day")).otherwise(F.col("_fx.rate_date")))
        .drop("_fx", "_day")
    )
