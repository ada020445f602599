"""Ranking, latest-per-key and position operators that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each key.

    Spark limits every map task to ``n`` rows per key before the shuffle (window group
    limit), so even a key holding a third of the data sends only n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def choose_best(df: DataFrame, key: str, orders: list[Column]) -> DataFrame:
    """Best candidate row per key under a multi-level ordering."""
    return first_per_key(df, [key], orders)


def with_group_max(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Group maximum beside every detail row.

    Aggregate-then-join instead of a window: the aggregate combines on the map side and an
    adaptive join splits a hot key, where a window would sort the whole group in one task.
    A null key is a group like any other.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    top = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.max(col).alias(out))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & df[k].eqNullSafe(top[n])
    return df.join(top, same).drop(*names)


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """1-based position of each row in its key's order, without ever gathering a key.

    Rows are range-partitioned on (keys, order), so a hot key spans many partitions. Rows
    are numbered inside each (partition, key); the offset of a key that continues from
    earlier partitions is added from a table with at most one row per partition.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    # materialised: the sampled range bounds must be the same for both uses below
    ranged = materialize(ranged, "ranged")
    group = ["_part", *keys]
    counts = ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # number of partitions bounds this: only a partition's first key can continue
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(earlier)).where(F.col("_before") > 0).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    null_safe = None
    numbered = ranged.withColumn("_in", inside).alias("a")
    for c in group:
        cond = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        null_safe = cond if null_safe is None else null_safe & cond
    joined = numbered.join(F.broadcast(offsets.alias("b")), null_safe, "left")
    position = F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], position.cast("long").alias(out))


def range_batches(df: DataFrame, key: str, rows_per_batch: int, out: str = "batch_no") -> DataFrame:
    """Batch number of each row when paging by ``key``: one range shuffle, no OFFSET scans."""
    numbered = ordinal(df, [], [key], "_pos")
    return numbered.withColumn(out, F.ceil(F.col("_pos") / rows_per_batch).cast("long")).drop("_pos")


def last_two(df: DataFrame, snapshot_id: str, ts: str, by: list[str], place: list[str] | None = None) -> DataFrame:
    """The newest and second-newest snapshot of each ``by`` that has two.

    (by, snapshot, place, _is_last, duration_sec): duration_sec lies between the two times.
    """
    place = list(place or [])
    ids = df.groupBy(*by, snapshot_id, *place).agg(F.max(ts).alias("_ts"))
    whole = Window.partitionBy(*by).orderBy(F.col(snapshot_id).desc())
    two = ids.withColumn("_rank", F.row_number().over(whole)).where("_rank <= 2")
    pair = Window.partitionBy(*by)  # two rows at most
    ends = two.withColumns({"_prev": F.min("_ts").over(pair), "_last": F.max("_ts").over(pair), "_n": F.count(F.lit(1)).over(pair)})
    return ends.where("_n = 2").select(
        *by, snapshot_id, *place, (F.col("_rank") == 1).alias("_is_last"), F.timestamp_diff("SECOND", "_prev", "_last").alias("duration_sec")
    )


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)
