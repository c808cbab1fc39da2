"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from larder.plans.oracle import ORACLE_SQL
from larder.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
