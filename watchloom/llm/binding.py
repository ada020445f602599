"""Names for intermediate values that no column of a caller can clash with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` mentions it, also per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with columns c0, c1 ..., and where each one is; ``restore`` gives them their names again."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return inner, {name: F.col(f"c{i}") for i, name in enumerate(df.columns)}


def restore(df: DataFrame, at: dict[str, Column], **results: Column) -> DataFrame:
    """The shielded columns under their names, and ``results``, which replace those of the same name."""
    own = [(results.pop(name) if name in results else c).alias(name) for name, c in at.items()]
    return df.select(*own, *[c.alias(name) for name, c in results.items()])
