"""All registered queries."""

from statutory.plans import aggregates, changes, grading, listing, predict, quality, rollcall, scalars, search, sources, streams, workspaces
from statutory.plans.registry import ORACLES, QUERIES

SECTIONS = (scalars, quality, listing, aggregates, rollcall, search, changes, predict, grading, sources, streams, workspaces)

__all__ = ["ORACLES", "QUERIES", "SECTIONS"]
