"""The history stored by listing, so that reading what is known today moves no rows.

A stored table is dealt into buckets by its key and sorted within them.  Two
tables dealt alike meet bucket by bucket, and a listing's points are together
already: ranking a history and joining it with its listings needs no exchange
of either.  Shops are few beside listings, and their runs are dealt by shop, so
the last good run of each is found in place, too.

A bucket is read by one task.  A listing has one point a run or a few, so
buckets differ little; their number is the caller's, and grows with the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pricetide.tables import LISTING_KEY, POINT_ORDER, PriceTables

#: By what each table is dealt, and in which order a bucket is kept.
LAYOUT = {
    "price_point": (LISTING_KEY, [*LISTING_KEY, *POINT_ORDER]),
    "listing": (LISTING_KEY, LISTING_KEY),
    "run_store": (["store_id"], ["store_id"]),
}


def store_keyed(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int) -> None:
    """Write ``df`` under ``path`` in ``buckets`` buckets by ``keys``, one sorted file each."""
    store_dealt(df.repartition(buckets, *keys), path, keys, order, buckets)


def store_dealt(dealt: DataFrame, path: str, keys: list[str], order: list[str], buckets: int) -> None:
    """``store_keyed`` of rows that lie in ``buckets`` partitions by ``keys`` already."""
    name = f"stored_{uuid.uuid4().hex}"
    dealt.write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(name)
    dealt.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_keyed(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """The table that ``store_keyed`` wrote, in any session; the layout has to be named as it was written."""
    name = f"stored_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    layout = f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {layout} LOCATION '{path}'")
    return spark.table(name)


def store_tables(t: PriceTables, path: str, buckets: int, names: Iterable[str] = tuple(LAYOUT)) -> None:
    """Write the tables of ``t`` that ``LAYOUT`` names, or some of them, under ``path``."""
    for name in names:
        store_keyed(getattr(t, name), f"{path}/{name}", *LAYOUT[name], buckets)


def stored_tables(t: PriceTables, path: str, buckets: int, names: Iterable[str] = tuple(LAYOUT)) -> PriceTables:
    """``t`` with the tables that ``store_tables`` wrote in place of its own; nothing of those is read."""
    spark = t.price_point.sparkSession
    found = {
        name: read_keyed(spark, f"{path}/{name}", getattr(t, name).schema, *LAYOUT[name], buckets) for name in names
    }
    return replace(t, **found)
