"""Operators on training text; nothing outside this package imports it."""

from inkwell.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
