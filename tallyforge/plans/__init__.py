"""Registered queries of the audit operators over the given tables, each with its SQL."""

from tallyforge.plans import streams  # noqa: F401  registers the streaming queries
from tallyforge.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
