"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import aggregation, classification, evaluation, joining, learning, reporting, sampling, scanning, textual, warning  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
