"""Reading and converting money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide import vocab
from pricetide.functions import charmap
from pricetide.functions.regex import let, pattern


def finite(col: Column) -> Column:
    return let(col, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)).cast("double")


def _number_text(kept: Column) -> Column:
    """Digits, points and commas to one plain number."""
    decimal_comma = F.regexp_replace(F.replace(kept, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    plain = F.replace(kept, F.lit(","), F.lit(""))
    return F.when(kept.contains(".") & kept.rlike(r",\d*$"), decimal_comma).otherwise(plain)


def parse_price(raw: Column) -> Column:
    """Price text to DOUBLE, NULL when it holds no number (never 0).

    Markers go first because the point of "Rs." would otherwise look like a
    decimal point.  Without any point a comma groups thousands; a comma after
    the last point is the decimal comma; else commas group thousands.
    """
    text = charmap.rewrite(raw.cast("string"), charmap.ascii_digit)
    kept = F.regexp_replace(F.regexp_replace(text, pattern(vocab.CURRENCY_MARKER), " "), r"[^0-9.,]", "")
    prefix = F.regexp_extract(let(kept, _number_text), vocab.NUMBER_PREFIX, 1)
    return finite(prefix.try_cast("double"))


def first_rupee_price(text: Column) -> Column:
    """The first figure written as rupees in free text, else NULL."""
    return parse_price(F.regexp_extract(text, pattern(vocab.RUPEE_FIGURE), 1))


def minor_units(price: Column, unit: Column) -> Column:
    """A price given in minor units (paise, cents); the exponent defaults to 2."""
    return price / F.pow(F.lit(10.0), F.coalesce(unit, F.lit(2)).cast("double"))


def fx_convert(native: Column, rate: Column) -> Column:
    """Home-currency price to 2 places; NULL without a rate.

    Rounded on the exact binary value, half to even: ``round`` works on the
    shortest decimal spelling instead and differs on some values.
    """
    return fixed_text(native * rate, 2).try_cast("double")


def fixed_text(number: Column, places: int) -> Column:
    """The number written with that many places, rounded on its exact binary value."""
    return F.call_function("format_number", number, F.lit("0." + "0" * places))


def price_looks_wrong(inr: Column, kind: Column) -> Column:
    """A game priced outside the plausible range."""
    return (kind == "GAME") & ((inr < vocab.GAME_PRICE_FLOOR) | (inr > vocab.GAME_PRICE_CEILING))


def change_pct(now: Column, before: Column) -> Column:
    return ((now - before) / F.nullif(before, F.lit(0.0))) * 100.0


def shown_change(now: Column, before: Column) -> Column:
    """The percentage change, NULL unless both prices exist and it is large enough."""
    pct = change_pct(now, before)
    return F.when(F.abs(pct) > vocab.MIN_CHANGE_PCT, pct)
