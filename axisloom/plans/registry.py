"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from axisloom.plans import arrays, blocks, fields, files, large, loops, more, spread, whole  # noqa: F401
from axisloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
