"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from svloom.plans import alignments, calls, files, intervals, trios  # noqa: F401  they register their queries
from svloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
