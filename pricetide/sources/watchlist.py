"""The watchlist and the aliases: hand-edited inputs, hence a trust boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab

WATCH_KEY = ["game", "platform"]


def _typed(value: Column, path: str, *types: str) -> Column:
    """A field of a VARIANT object as text, NULL unless it has one of the types."""
    field = F.try_variant_get(value, path, "variant")
    kind = F.regexp_extract(F.schema_of_variant(field), r"^[A-Z]+", 0)
    return F.when(kind.isin(*types), F.try_variant_get(value, path, "string"))


def read_watchlist(documents: DataFrame) -> DataFrame:
    """Watch rows from JSON array documents (column ``body``).

    A target that is not a positive number means no target; an unknown
    condition means ANY, unknown shops mean ALL; entries without game or
    platform are dropped, unreadable documents are empty.  Types are tested,
    not cast: the text "4000" is not a number.
    """
    item = F.col("item")
    items = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    parsed = documents.select(F.posexplode(items).alias("position", "item"))
    number = _typed(item, "$.target", "BIGINT", "DOUBLE", "DECIMAL").cast("double")
    condition, shops = _typed(item, "$.condition", "STRING"), _typed(item, "$.shops", "STRING")
    return parsed.select(
        "position",
        _typed(item, "$.game", "STRING").alias("game"),
        _typed(item, "$.platform", "STRING").alias("platform"),
        F.when(number > 0, number).alias("target"),
        F.when(condition.isin(*vocab.WATCH_CONDITIONS), condition).otherwise("ANY").alias("condition"),
        F.when(shops.isin(*vocab.WATCH_SHOPS), shops).otherwise("ALL").alias("shops"),
    ).where(F.col("game").isNotNull() & F.col("platform").isNotNull())


def watchlist_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge changes (game, platform, ord, set_target, target, condition, shops).

    ``set_target`` tells "leave the target" from "clear it"; NULL condition or
    shops keep what is there.  Several changes to one watch apply in order:
    each field takes its newest given value.  All duplicates of a changed
    watch are replaced by one row, which starts from the first of them.
    """
    field = F.struct("ord")
    target = F.max_by(F.when(F.col("set_target"), F.struct("target")), F.when(F.col("set_target"), field))
    merged = changes.groupBy(*WATCH_KEY).agg(
        target.alias("_target"),
        F.max_by("condition", F.when(F.col("condition").isNotNull(), field)).alias("_condition"),
        F.max_by("shops", F.when(F.col("shops").isNotNull(), field)).alias("_shops"),
    )
    order = ["position"] if "position" in current.columns else ["target", "condition", "shops"]
    first = current.groupBy(*WATCH_KEY).agg(
        F.min_by(F.struct("target", "condition", "shops"), F.struct(*order)).alias("_now")
    )
    changed = merged.join(first, WATCH_KEY, "left").select(
        *WATCH_KEY,
        F.when(F.col("_target").isNotNull(), F.col("_target.target")).otherwise(F.col("_now.target")).alias("target"),
        F.coalesce("_condition", "_now.condition", F.lit("ANY")).alias("condition"),
        F.coalesce("_shops", "_now.shops", F.lit("ALL")).alias("shops"),
    )
    untouched = current.join(merged, WATCH_KEY, "left_anti").select(*WATCH_KEY, "target", "condition", "shops")
    return untouched.unionByName(changed)


def watchlist_remove(current: DataFrame, removed: DataFrame) -> DataFrame:
    return current.join(removed.select(*WATCH_KEY), WATCH_KEY, "left_anti")

