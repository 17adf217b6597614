"""Pages that go on where the last one ended.

A cursor holds the sort keys of a page's last row.  The next page filters by it
before anything is sorted, so each task keeps one page of rows and page 10,000 costs
what the first one does, where an offset would keep and drop all rows before
it.  The last sort keys name a row, so pages join without a gap or a repeat,
whatever ties there are and wherever NULLs go.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SortKey:
    """One key of an order: an expression over the rows, its direction, and where NULLs go."""

    value: Column
    descending: bool = False
    nulls_first: bool = True

    @property
    def order(self) -> Column:
        if self.descending:
            return F.desc_nulls_first(self.value) if self.nulls_first else F.desc_nulls_last(self.value)
        return F.asc_nulls_first(self.value) if self.nulls_first else F.asc_nulls_last(self.value)

    def beyond(self, last: object) -> Column:
        """Rows that come after the value ``last``."""
        if last is None:
            return self.value.isNotNull() if self.nulls_first else F.lit(False)
        further = self.value < F.lit(last) if self.descending else self.value > F.lit(last)
        further = F.coalesce(further, F.lit(False))
        return further if self.nulls_first else further | self.value.isNull()


def after(keys: Sequence[SortKey], cursor: Sequence[object]) -> Column:
    """Rows that come after the row with these key values."""
    if len(cursor) != len(keys):
        raise ValueError(f"a cursor of {len(keys)} values, not {len(cursor)}")
    same, out = F.lit(True), F.lit(False)
    for key, last in zip(keys, cursor, strict=True):
        out = out | (same & key.beyond(last))
        same = same & key.value.eqNullSafe(F.lit(last))
    return out


def page(rows: DataFrame, keys: Sequence[SortKey], limit: int, offset: int = 0, cursor: Sequence[object] | None = None) -> DataFrame:
    """``limit`` rows in order, from the first, after ``offset`` rows, or after the row of ``cursor``."""
    if cursor is not None:
        rows = rows.where(after(keys, cursor))
    ordered = rows.orderBy(*[k.order for k in keys])
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def cursor_of(keys: Sequence[SortKey]) -> Column:
    """The key values of a row in one struct: a cursor to go on after it."""
    return F.struct(*[k.value.alias(f"k{i}") for i, k in enumerate(keys)])
