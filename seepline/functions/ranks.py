"""Ordinals of severity and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Order of levels.
SEVERITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
CONFIDENCE = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def _ordinal(col: Column, order: dict[str, int]) -> Column:
    out = None
    for name, rank in order.items():
        out = F.when(col == name, rank) if out is None else out.when(col == name, rank)
    return out.otherwise(0)


def severity_rank(col: Column) -> Column:
    return _ordinal(col, SEVERITY)


def confidence_rank(col: Column) -> Column:
    return _ordinal(col, CONFIDENCE)
