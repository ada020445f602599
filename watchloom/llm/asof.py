"""As-of lookup that no key can overload.

Rows are dealt by ranges of (key, order), so a key of any size spans as many partitions as
it needs. Inside a partition a window carries the last source row forward; across partitions
only the greatest source row of each partition is carried, one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import materialize


def last_before(rows: DataFrame, keys: list[str], order: list[str], is_source: Column, value: str) -> DataFrame:
    """``rows`` and ``found``: ``value`` of the last source row before, of the same keys; null without one.

    "Before" is strictly less in ``order``, whose columns must set rows of a key apart where
    that matters. Keys must not be null; ``value`` must be orderable.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__src", is_source).repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ranges")
    source = F.when(F.col("__src"), F.struct(*keys, *order, value))
    ends = placed.groupBy("__part").agg(F.max(source).alias("last"))
    # One row per range partition, however many rows there are.
    before = ends.select("__part", F.max("last").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.last(F.when(F.col("__src"), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(inside)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"__carry.{k}") == F.col(k))
    found = placed.withColumn("__local", local).join(before, "__part", "left")
    return found.withColumn("found", F.when(F.col("__local").isNotNull(), F.col("__local.v")).when(same, F.col(f"__carry.{value}"))).drop("__src", "__part", "__local", "__carry")
