"""Character-by-character rewriting, derived from Unicode data by rule.

A rule gives the replacement of one character.  The tables it produces are
computed once on the driver and become constants of the plan, so no Python
runs per row.  Text that is plain ASCII, the common case, is passed through
after a single test.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.regex import let

_NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=None)
def _tables(rule: Callable[[str], str | None]) -> tuple[str, str, dict[str, str]]:
    singles_from, singles_to, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        out = rule(char)
        if not out or out == char:
            continue
        if len(out) == 1:
            singles_from.append(char)
            singles_to.append(out)
        else:
            longer[char] = out
    return "".join(singles_from), "".join(singles_to), longer


def rewrite(col: Column, rule: Callable[[str], str | None], drop_rest: bool = False) -> Column:
    """Apply ``rule`` to each non-ASCII character; optionally drop what stays non-ASCII."""
    source, target, longer = _tables(rule)

    def expand(text: Column) -> Column:
        # One literal instead of a tree of a thousand; folded into a constant map.
        table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
        chars = F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike(_NON_ASCII), F.coalesce(F.element_at(table, c), c)).otherwise(c),
        )
        return F.when(text.rlike(_NON_ASCII), F.array_join(chars, "")).otherwise(text)

    def change(text: Column) -> Column:
        out = F.translate(text, source, target) if source else text
        out = let(out, expand) if longer else out
        return F.regexp_replace(out, _NON_ASCII, "") if drop_rest else out

    return let(col, lambda text: F.when(text.rlike(_NON_ASCII), change(text)).otherwise(text))


def compatibility_ascii(char: str) -> str | None:
    """What is left of a character after compatibility decomposition to ASCII."""
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


def compatibility_ascii_no_bar(char: str) -> str | None:
    """The same, except that no look-alike turns into a ``|`` separator."""
    return compatibility_ascii(char).replace("|", "/")


def ascii_digit(char: str) -> str | None:
    value = unicodedata.decimal(char, None)
    return None if value is None else str(value)


def full_casefold(char: str) -> str | None:
    folded = char.casefold()
    return folded if folded != char.lower() else None
