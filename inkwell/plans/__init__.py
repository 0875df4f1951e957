"""Core queries; importing this package registers all of them."""

from inkwell.plans import instants, lints, measures, merging, relational, scalars, streams
from inkwell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "instants", "lints", "measures", "merging", "relational", "scalars", "streams"]
