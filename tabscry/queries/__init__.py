"""Registered queries over the given tables, each with its SQL check where one exists."""

from tabscry.queries.registry import ORACLES, QUERIES
from tabscry.queries import base, log_queries, profile, quality_queries, series_queries, text_queries, typing_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
