"""Registered queries: each operator over the given tables, with its SQL check."""

from packsift.plans import aggregates, composites, job_runs, joins, projections, scans, sources, streams, windows  # noqa: F401
from packsift.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
