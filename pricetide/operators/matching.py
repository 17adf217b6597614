"""Grouping listings into products across shops.

A re-runnable pass over stored titles.  It errs on the side of splitting: a
missed merge costs one alias, a wrong one mixes two price series.  Beyond the
title key two merges are made, each confirmed by the data: an optional
publisher name comes off when the rest is another listing's key, and keys of
the same words in another order become one.

All evidence is gathered on distinct titles and then on distinct keys.  The
listings themselves take part in one aggregation and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.platforms import named_platform
from pricetide.functions.titles import confirmed_prefix_rest, variant_word, with_match_key, word_set
from pricetide.functions.regex import once
from pricetide.operators.common import first_row, top_rows
from pricetide.session import hold
from pricetide.tables import LISTING_KEY

PAIR = ["key", "platform"]


def platform_relabel(title: Column, stored: Column) -> Column:
    """The console a title names wins over the stored one."""
    return F.coalesce(named_platform(title), stored)


def aliases_by_key(aliases: DataFrame) -> DataFrame:
    """Alias titles as keys; empty targets are dropped, the last entry (by ``ord``) for a key wins."""
    keyed = with_match_key(with_match_key(aliases, "from_title", "key"), "to_title", "target")
    kept = keyed.where(F.col("target") != "")
    return first_row(kept, ["key"], [F.desc("ord")]).select("key", "target")


def keyed_titles(listing: DataFrame) -> DataFrame:
    """Distinct (raw_title, platform) with relabelled platform, key and number of listings."""
    titles = listing.groupBy("raw_title", F.col("platform").alias("stored_platform")).agg(
        F.count(F.lit(1)).alias("n")
    )
    relabelled = {"platform": platform_relabel(F.col("raw_title"), F.col("stored_platform"))}
    return once(with_match_key(titles, "raw_title", "key"), relabelled)


def _groupable(titles: DataFrame) -> DataFrame:
    """Titles that can be compared: a key, on a known console."""
    return titles.where((F.col("key") != "") & (F.col("platform") != "UNKNOWN"))


def confirmed_prefix_join(keys: DataFrame) -> DataFrame:
    """(key, platform, stripped) for keys whose rest after a publisher name is itself a key.

    Only keys with such a rest enter the join, so no NULL or empty value
    gathers in one partition.
    """
    candidates = (
        keys.select(*PAIR)
        .withColumn("stripped", confirmed_prefix_rest(F.col("key")))
        .where(F.col("stripped") != "")
    )
    known = keys.select(F.col("key").alias("stripped"), "platform")
    return candidates.join(known, ["stripped", "platform"], "left_semi")


def canonical_keys(uses: DataFrame) -> DataFrame:
    """(key, platform, canonical): the spelling that stands for each set of words.

    Most listings first, then the shorter, then A-Z.  "vs" is exempt, there
    the order of the words is the product.
    """
    sets = uses.withColumn("words", word_set(F.col("key"))).where(~F.array_contains("words", "vs"))
    best = sets.groupBy("platform", "words").agg(
        F.min(F.struct((-F.col("uses")).alias("u"), F.length("key").alias("l"), F.col("key").alias("k"))).alias("b"),
        F.count(F.lit(1)).alias("spellings"),
    )
    several = best.where("spellings > 1").select("platform", "words", F.col("b.k").alias("canonical"))
    return sets.join(several, ["platform", "words"]).select(*PAIR, "canonical").where("key <> canonical")


def _follow(df: DataFrame, column: str, mapping: DataFrame, to: str) -> DataFrame:
    """Replace ``column`` by ``to`` where the mapping knows it (on the same platform)."""
    known = mapping.select(F.col("key").alias(column), "platform", F.col(to).alias("_to"))
    return (
        df.join(known, [column, "platform"], "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_to")
    )


def key_mapping(keys: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, platform) to ``game`` from distinct keys with their listing counts ``n``.

    The keys with their confirmed prefixes gone are held: every later step
    reads them, some twice.
    """
    plain = hold(_follow(keys.withColumn("game", F.col("key")), "game", confirmed_prefix_join(keys), "stripped"))
    uses = plain.groupBy(F.col("game").alias("key"), "platform").agg(F.sum("n").alias("uses"))
    canonical = hold(canonical_keys(uses))
    final = _follow(plain, "game", canonical, "canonical").select(*PAIR, "game")
    if aliases is None:
        return final
    stripped = plain.where("key <> game").select(*PAIR, F.col("game").alias("stripped"))
    return alias_join(final, aliases_by_key(aliases), stripped, canonical)


def alias_join(
    final: DataFrame, aliases: DataFrame, stripped: DataFrame, canonical: DataFrame
) -> DataFrame:
    """Apply aliases, looked up under the raw key first, else under the final one.

    The target joins the group its own listings ended up in.
    """
    by_key = hold(aliases)
    by_raw = by_key.select("key", F.col("target").alias("_raw"))
    by_final = by_key.select(F.col("key").alias("game"), F.col("target").alias("_final"))
    targeted = (
        final.join(by_raw, "key", "left")
        .join(by_final, "game", "left")
        .withColumn("target", F.coalesce("_raw", "_final"))
        .drop("_raw", "_final")
    )
    # Keys without an alias have a NULL target; they stay out of the two look-ups.
    moved = targeted.where(F.col("target").isNotNull())
    resolved = _follow(_follow(moved, "target", stripped, "stripped"), "target", canonical, "canonical")
    return (
        targeted.where(F.col("target").isNull())
        .select(*PAIR, "game")
        .unionByName(resolved.select(*PAIR, F.col("target").alias("game")))
    )


def title_mapping(listing: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct (raw_title, stored_platform) to (game, platform); ``game`` NULL when it cannot be grouped.

    The keyed titles are the costly part (text rules) and are needed twice, so
    they are held.
    """
    titles = hold(keyed_titles(listing))
    keys = _groupable(titles).groupBy(*PAIR).agg(F.sum("n").alias("n"))
    mapping = key_mapping(keys, aliases)
    columns = ["raw_title", "stored_platform", "platform", "game"]
    # Titles without a key share one empty key and take no part in the join.
    groupable = (F.col("key") != "") & (F.col("platform") != "UNKNOWN")
    alone = titles.where(~F.coalesce(groupable, F.lit(False))).withColumn("game", F.lit(None).cast("string"))
    return titles.where(groupable).join(mapping, PAIR).select(*columns).unionByName(alone.select(*columns))


def assign_games(listing: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The whole pass: listings with relabelled ``platform``, new ``game`` and what was stored before."""
    kept = [c for c in listing.columns if c not in ("game", "platform")]
    stored = listing.withColumnsRenamed({"platform": "stored_platform", "game": "stored_game"})
    mapped = title_mapping(listing.select("raw_title", "platform"), aliases)
    # NULL-safe: a listing without title or platform stays, ungrouped
    theirs = mapped.withColumnsRenamed({"raw_title": "_title", "stored_platform": "_platform"})
    same = F.col("raw_title").eqNullSafe(F.col("_title")) & F.col("stored_platform").eqNullSafe(F.col("_platform"))
    out = stored.join(theirs, same, "left").drop("_title", "_platform")
    extra = ["stored_game"] if "game" in listing.columns else []
    return out.select(*kept, "platform", "game", "stored_platform", *extra)


def game_table(assigned: DataFrame) -> DataFrame:
    """Products in use; those no listing points at are simply not there."""
    return assigned.where(F.col("game").isNotNull()).select("game", "platform", "region").distinct()


def game_redirects(assigned: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Where vanished product keys went.

    A key not live any more whose listings all moved to one new key; split
    over several it is ambiguous and nothing is recorded.  An existing
    redirect is replaced by a newer one and removed once its key is live again.
    ``stored_platform``/``stored_game`` name the product as it was.

    Which products became which is asked twice, so it is held; the listings are read once.
    """
    became = hold(assigned.select("stored_game", "stored_platform", "game", "platform").distinct())
    old = [F.col("stored_game").alias("old_title"), F.col("stored_platform").alias("platform")]
    moved = (
        became.where(F.col("stored_game").isNotNull())
        .groupBy(*old)
        .agg(
            F.min("game").alias("new_title"),
            F.max("game").alias("_other"),
            F.count_if(F.col("game").isNull()).alias("_lost"),
        )
        .where((F.col("_lost") == 0) & (F.col("new_title") == F.col("_other")))
        .select("old_title", "platform", "new_title")
    )
    if existing is not None:
        key = ["old_title", "platform"]
        moved = existing.select(*key, "new_title").join(moved, key, "left_anti").unionByName(moved)
    live = became.where(F.col("game").isNotNull()).select(F.col("game").alias("old_title"), "platform").distinct()
    return moved.join(live, ["old_title", "platform"], "left_anti")


def rematch_preview(assigned: DataFrame) -> DataFrame:
    """New groups made of more than one stored group: one row per stored group, with its listings."""
    stored = (
        assigned.where(F.col("game").isNotNull())
        .groupBy("game", "platform", F.coalesce("stored_game", F.lit("(ungrouped)")).alias("stored_group"), "stored_platform")
        .agg(F.count(F.lit(1)).alias("listings"))
    )
    several = stored.groupBy("game", "platform").agg(F.count(F.lit(1)).alias("merged_groups")).where("merged_groups > 1")
    return stored.join(several, ["game", "platform"])


def relabelled_platforms(assigned: DataFrame) -> DataFrame:
    """Grouped listings whose title names another console than the stored one."""
    return assigned.where(F.col("game").isNotNull() & (F.col("platform") != F.col("stored_platform"))).select(
        *LISTING_KEY, "raw_title", "stored_platform", "platform"
    )


def _named_editions(assigned: DataFrame) -> DataFrame:
    """(game, platform, word): words some title of the product puts right before "edition"."""
    before_edition = F.regexp_extract_all(F.lower("raw_title"), F.lit(r"(?iU)(?<!\w)(\w+)(?=\W+edition\b)"), 1)
    return (
        assigned.where(F.col("game").isNotNull())
        .select("game", "platform", F.explode(before_edition).alias("word"))
        .distinct()
    )


def subset_key_join(assigned: DataFrame) -> DataFrame:
    """Pairs of products that may be one: the longer key is the shorter plus one or two words.

    The extra words may be neither numbers, variant words nor a named edition,
    and the shorter key has two words at least.  The shorter key is listed under
    its rarest word, which the longer one must hold: each key asks, for each of
    its words, for keys one or two words smaller that are listed there.  A key adds
    rows in proportion to its words, and only those that meet have their words compared.
    """
    games = assigned.where(F.col("game").isNotNull()).select("game", "platform").distinct()
    sets = hold(games.withColumn("words", word_set(F.col("game"))))
    words = sets.select("game", "platform", "words", F.explode("words").alias("word"))
    common = words.groupBy("platform", "word").agg(F.count(F.lit(1)).alias("keys"))
    listed = (
        words.where(F.size(F.split("game", " ")) >= 2)
        .join(common, ["platform", "word"])
        .groupBy("game", "platform")
        .agg(F.min_by("word", F.struct("keys", "word")).alias("word"), F.first("words").alias("rest"))
        .select(F.col("game").alias("short_key"), "platform", "rest", "word", F.size("rest").alias("size"))
    )
    asked = words.select(
        F.col("game").alias("long_key"), "platform", "words", "word", F.explode(F.array(F.size("words") - 1, F.size("words") - 2)).alias("size")
    )
    met = listed.join(asked, ["platform", "word", "size"]).where(F.size(F.array_except("rest", "words")) == 0)
    extra = F.array_except("words", "rest")
    pairs = met.where(~F.exists(extra, variant_word)).select("platform", "short_key", "long_key", extra.alias("extra"))
    editions = _named_editions(assigned).select(F.col("game").alias("long_key"), "platform", "word")
    excluded = (
        pairs.withColumn("word", F.explode("extra"))
        .join(editions, ["long_key", "platform", "word"], "left_semi")
        .drop("word")
    )
    return (
        pairs.join(excluded, ["platform", "short_key", "long_key", "extra"], "left_anti")
        .select("platform", "short_key", "long_key")
        .distinct()
    )


def sample_per_group(assigned: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` listings of each product, by store."""
    grouped = assigned.where(F.col("game").isNotNull())
    order = [F.asc("store_id"), F.asc("sku")]
    return top_rows(grouped, ["game", "platform"], order, n).select(
        "game", "platform", F.col("rn").alias("nth"), "store_id", "raw_title"
    )

