"""Ratio, unit and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(n: str, d: str) -> Column:
    """Truncating integer ratio of two columns; 0 when the denominator is 0."""
    return F.expr(f"CASE WHEN ({d}) = 0 THEN 0L ELSE ({n}) div ({d}) END")


def pages_kb(c: str | Column) -> Column:
    return _col(c) * 8


def fingerprint(*cols: str | Column) -> Column:
    """md5 over the columns, nulls kept apart from empty text."""
    marked = [F.coalesce(F.concat(F.lit("v"), _col(c).cast("string")), F.lit("n")) for c in cols]
    return F.md5(F.concat_ws("\u0001", *marked).cast("binary"))


def tier(value: str | Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the band a value falls in: ``labels[i]`` while value <= ``bounds[i]``."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("one label more than bounds")
    v = _col(value)
    out = F.when(v <= bounds[0], labels[0])
    for b, label in zip(bounds[1:], labels[1:]):
        out = out.when(v <= b, label)
    return F.when(v.isNotNull(), out.otherwise(labels[-1]))
