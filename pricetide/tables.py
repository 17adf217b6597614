"""The logical tables and their natural keys.

Observations are immutable facts.  Listing state, product assignment and every
view are derived from them.  A listing is identified by its natural key
(store_id, sku); no surrogate numbers are handed out, so independent jobs
agree on identity without coordination.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

LISTING_KEY = ["store_id", "sku"]
GAME_KEY = ["game", "platform"]
#: Newest last.  ``point_id`` is unique within a listing.
POINT_ORDER = ["captured_at", "point_id"]


@dataclass(frozen=True)
class PriceTables:
    """DataFrames under their logical names; see README for the columns.

    ``listing.game`` is the product key a listing is grouped under, NULL while
    it is ungrouped.  ``latest`` is optional: the two newest points of each
    listing, as ``history.two_newest`` and the streaming job keep them.  Where
    it is given, what is known today is read from there, and the history is
    not ranked again.  ``record`` is optional, too: what ``records.records``
    makes of the history, merged run by run; price records are then read from it.
    """

    store: DataFrame | None = None
    listing: DataFrame | None = None
    price_point: DataFrame | None = None
    run: DataFrame | None = None
    run_store: DataFrame | None = None
    run_event: DataFrame | None = None
    fx_rate: DataFrame | None = None
    watchlist: DataFrame | None = None
    aliases: DataFrame | None = None
    redirect: DataFrame | None = None
    latest: DataFrame | None = None
    record: DataFrame | None = None

    @property
    def recent(self) -> DataFrame:
        """Points among which the two newest of every listing are for certain."""
        return self.price_point if self.latest is None else self.latest

    def with_(self, **changes: DataFrame) -> PriceTables:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise KeyError(f"not a table: {sorted(unknown)}")
        return replace(self, **changes)
