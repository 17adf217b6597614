"""Price-observation analytics on Spark.

The package turns landed shop feeds and pages into listings, appends one price
observation per listing and run, groups listings into products, and answers
questions over the whole observation history.  Everything is a function from
DataFrames to DataFrames; Catalyst and AQE choose the physical plan.
"""

from pricetide.tables import PriceTables
from pricetide.session import build_session, prepare

__all__ = ["PriceTables", "build_session", "prepare"]
