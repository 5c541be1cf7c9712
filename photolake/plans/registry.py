"""Queries over the supplied tables, each with the SQL that it is held against."""

from photolake.plans import activity, collection, detections, people, pixels, runs, summaries  # noqa: F401  they list their queries
from photolake.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
