"""Platform, product kind, region and condition from listing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.functions.regex import any_of, let, matches, once, pattern, squeeze


def unmark(text: Column) -> Column:
    """Trademark signs read as spaces."""
    return F.translate(text, vocab.TRADE_MARKS, " " * len(vocab.TRADE_MARKS))


def named_platform(text: Column) -> Column:
    """The console a text names, UNKNOWN for somebody else's, NULL for none.

    The order of the branches is the meaning: a list of both consoles is the
    older one, an explicit other console beats a bare "switch".
    """

    def read(clean: Column) -> Column:
        lists_both = matches(clean, vocab.BOTH_SWITCHES) & ~matches(clean, vocab.EXPLICIT_SWITCH2)
        return (
            F.when(lists_both, F.lit("SWITCH"))
            .when(matches(clean, vocab.SWITCH2), F.lit("SWITCH2"))
            .when(matches(clean, vocab.SWITCH), F.lit("SWITCH"))
            .when(matches(clean, vocab.OTHER_CONSOLE), F.lit("UNKNOWN"))
            .when(matches(clean, vocab.SWITCH_LOOSE), F.lit("SWITCH"))
        )

    return let(unmark(text), read)


def platform_of(text: Column, hint: Column | None = None) -> Column:
    fallback = [] if hint is None else [hint]
    return F.coalesce(named_platform(text), *fallback, F.lit("UNKNOWN"))


def _without_model_lists(product: Column) -> Column:
    """A text naming both models lists what a game runs on; the names go."""
    lists_models = matches(product, r"\blite\b") & matches(product, r"\boled\b")
    no_models = F.regexp_replace(product, pattern(vocab.COMPATIBLE_MODELS), " ")
    return F.when(lists_models, no_models).otherwise(product)


def _excluded_kind(text: Column) -> Column:
    """What a product is when it is not a game; the part before the first ``|`` names it."""
    head = F.substring_index(text, "|", 1)
    extra_content = matches(head, vocab.DIGITAL_HEAD) & ~matches(text, vocab.PHYSICAL)
    return (
        F.when(matches(text, vocab.SERVICE), "SERVICE")
        .when(matches(text, vocab.DIGITAL) | extra_content, "DIGITAL")
        .when(matches(text, vocab.HARDWARE) | matches(head, vocab.HARDWARE_HEAD), "HARDWARE")
        .when(matches(text, vocab.ACCESSORY), "ACCESSORY")
    )


def classify(context: Column, hint: Column | None = None, title: Column | None = None) -> Column:
    """STRUCT<platform, kind>.

    ``context`` is everything the shop says; ``title``, where the shop has
    one, is the only text the exclusions read, and the console it names wins.
    """
    product = F.regexp_replace(squeeze(context if title is None else title), pattern(vocab.INCLUDES), " ")
    platform = platform_of(squeeze(context), hint)
    if title is not None:
        platform = F.coalesce(named_platform(title), platform)
    excluded = let(let(product, _without_model_lists), _excluded_kind)
    return let(
        F.struct(platform.alias("platform"), excluded.alias("kind")),
        lambda c: F.struct(
            c["platform"].alias("platform"),
            F.coalesce(c["kind"], F.when(c["platform"] == "UNKNOWN", "UNKNOWN").otherwise("GAME")).alias("kind"),
        ),
    )


def with_classification(
    df: DataFrame, context: Column, hint: Column | None = None, title: Column | None = None
) -> DataFrame:
    """Add ``platform`` and ``kind``; no filter on them computes them again."""
    verdict = once(df, {"_verdict": classify(context, hint, title)})
    return verdict.withColumns(
        {"platform": F.col("_verdict.platform"), "kind": F.col("_verdict.kind")}
    ).drop("_verdict")


def infer_region(title: Column, default: Column) -> Column:
    """First matching rule, else the store's default."""
    first, *rest = vocab.REGION_RULES
    out = F.when(title.rlike(pattern(first[0])), first[1])
    for source, region in rest:
        out = out.when(title.rlike(pattern(source)), region)
    return out.otherwise(default)


def infer_condition(context: Column) -> Column:
    """NEW unless the text says otherwise."""
    return F.when(context.rlike(any_of(vocab.PRE_OWNED)), "PRE_OWNED").otherwise("NEW")


def condition_tier(asserted: Column, from_context: Column, context: Column, title: Column) -> Column:
    """What the store asserts, else card text where opted in, else the title."""
    use_card = F.coalesce(from_context, F.lit(False)) & (F.coalesce(context, F.lit("")) != "")
    return F.coalesce(asserted, F.when(use_card, infer_condition(context)).otherwise(infer_condition(title)))
