"""Range numbers from a table of boundaries, by one sorted merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import materialize


def assign_boundaries(
    rows: DataFrame, value: Column | str, boundaries: DataFrame, boundary: str = "boundary", by: list[str] | None = None, right: bool = True, out: str = "partition_no"
) -> DataFrame:
    """1-based number of the range that a row's value lies in, per entity (``by``), open at both ends.

    ``boundaries`` has the ``by`` columns and ``boundary``; repeated ones count once. ``right``: a
    boundary value belongs to the range on its right. A null value has a null number, a row whose entity
    has no boundaries is in range 1; null entities are an entity.

    Rows and boundaries are dealt together by ranges of (entity, value), each partition counts its own
    boundaries in order, and what earlier partitions hold of an entity that continues is added from at most one
    row per partition. Entities, values and boundary tables of any size spread over all tasks; nothing is
    compared pairwise.
    """
    by = list(by or [])
    keys = [f"_k{i}" for i in range(len(by))]
    shown = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns)]
    value = F.col(value) if isinstance(value, str) else value
    tagged = rows.select(*shown, *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], value.alias("_v"), F.lit(1 if right else 0).alias("_tie"), F.monotonically_increasing_id().alias("_salt"))
    kinds = {f.name: f.dataType for f in tagged.schema}
    given = {f.name: f.dataType for f in boundaries.schema}

    def like(name: str, key: str) -> Column:
        same = given[name].simpleString() == kinds[key].simpleString()
        return (F.col(f"`{name}`") if same else F.col(f"`{name}`").cast(kinds[key])).alias(key)

    edge = boundaries.select(*[like(b, k) for b, k in zip(by, keys)], like(boundary, "_v"))
    edge = edge.where("_v IS NOT NULL").distinct().withColumns({"_tie": F.lit(0 if right else 1), "_salt": F.lit(None).cast("long")})
    edge = edge.select(*[F.lit(None).cast(kinds[f"_c{i}"]).alias(f"_c{i}") for i in range(len(rows.columns))], *keys, "_v", "_tie", "_salt")
    order = ["_v", "_tie", "_salt"]
    # A value that most rows share is spread by the rows' own numbers. Written once: the sampled
    # bounds must be the same for both uses below.
    dealt = tagged.unionByName(edge).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("_edge", F.col("_salt").isNull().cast("long")), "ranges")
    counts = dealt.groupBy("_part", *keys).agg(F.sum("_edge").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0")
    carried = carried.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_before")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    inside = F.sum("_edge").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # Only the entity that a partition begins with can continue: one row per partition at most.
    met = dealt.withColumn("_in", inside).where("_edge = 0").join(F.broadcast(carried), same, "left")
    number = F.when(F.col("_v").isNotNull(), 1 + F.col("_in") + F.coalesce("_before", F.lit(0)))
    return met.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(rows.columns)], number.alias(out))
