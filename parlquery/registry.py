"""All queries of the engine and their SQL."""

from __future__ import annotations

from .plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
