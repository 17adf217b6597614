"""Compiling pattern lists for the JVM regex engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ignore case; Unicode classes, word boundaries and case folding; only a line
#: feed ends a line.
FLAGS = "(?iUd)"


def pattern(source: str) -> str:
    return FLAGS + source


def _alternatives(source: str) -> bool:
    """Whether a pattern is several at its outermost level."""
    depth, at, in_class = 0, 0, False
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
        at += 1
    return False


def any_of(sources: Sequence[str]) -> str:
    """One alternation, so a whole list costs one pass over the text.

    Patterns that begin at a word boundary share the test for it: where there
    is none, and that is most of a text, none of them is tried.
    """
    bounded = [s for s in sources if s.startswith(r"\b") and s[2:3] not in ("?", "*", "+", "{") and not _alternatives(s)]
    if len(bounded) < 2:
        return FLAGS + "(?:" + "|".join(sources) + ")"
    shared = r"\b(?:" + "|".join(s[2:] for s in bounded) + ")"
    return FLAGS + "(?:" + "|".join([shared, *[s for s in sources if s not in bounded]]) + ")"


def matches(col: Column, sources: str | Sequence[str]) -> Column:
    return col.rlike(pattern(sources) if isinstance(sources, str) else any_of(sources))


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    The optimizer copies the definition of a projected column into every
    filter and projection that mentions it.  For chains of regular expressions
    that multiplies both the plan and the work; a bound variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, each computed once per row, whatever filters and projections mention them later.

    Filters are not moved below a generator, so they cannot bring a copy of the definition along.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[col.alias(name) for name, col in columns.items()]))))
