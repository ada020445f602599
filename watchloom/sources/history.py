"""Append-only history tables: snapshot append, retention and batch-idempotent writes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.functions.calendar import ts_key
from watchloom.session import materialize


def stamp_snapshot(df: DataFrame, as_of: datetime) -> DataFrame:
    """Add one log time, its 14-digit snapshot id and the ``log_date`` partition column."""
    at = ntz(as_of)
    return df.withColumns({"log_time": at, "snapshot_id": ts_key(at, 14), "log_date": F.to_date(at)})


def append_snapshot(df: DataFrame, path: str, as_of: datetime) -> None:
    stamp_snapshot(df, as_of).write.mode("append").partitionBy("log_date").parquet(path)


def purge_expired(df: DataFrame, ts: str, days: int, as_of: datetime) -> DataFrame:
    """Rows at or after ``as_of`` minus ``days`` days; only strictly older rows go."""
    limit = ntz(as_of - timedelta(days=days))
    return df.where(F.col(ts) >= limit)


def purge_history(df: DataFrame, ts: str, days: int, as_of: datetime, partition: str = "log_date") -> DataFrame:
    """As ``purge_expired`` on a partitioned history: the date bound prunes whole partitions."""
    first_day = (as_of - timedelta(days=days)).date()
    return purge_expired(df.where(F.col(partition) >= F.lit(first_day)), ts, days, as_of)


def purge_stored(spark: SparkSession, path: str, ts: str, days: int, as_of: datetime, partition: str = "log_date") -> None:
    """Delete what has expired from a stored history: whole days go, the boundary day is rewritten.

    The rows of the boundary day that stay are written aside first and then replace their
    partitions in one commit, so a failure leaves either the old day or the new one. Days are
    listed, not rows; a second purge changes nothing.
    """
    limit = as_of - timedelta(days=days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return
    names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith(f"{partition}=")]
    day = limit.date().isoformat()
    for name in names:
        if name.partition("=")[2] < day:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    if f"{partition}={day}" in names:
        stored = spark.read.option("basePath", path).parquet(f"{path}/{partition}={day}")
        kept = materialize(stored.where(F.col(ts) >= ntz(limit)), "boundary")
        inner = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{partition}={day}")) if f.isDirectory()]
        parts = [partition, *dict.fromkeys(n.partition("=")[0] for n in inner)]
        left = {tuple(str(v) for v in r) for r in kept.select(*parts).distinct().collect()}  # partitions of one day
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
        for name in inner or [""]:
            if (day, *([name.partition("=")[2]] if name else [])) not in left:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{partition}={day}/{name}".rstrip("/")), True)


def write_dated_batch(df: DataFrame, path: str, batch_id: int, ts: str, partition: str = "log_date") -> None:
    """Write one micro-batch by day and batch, so that reads prune by day and a replay replaces its own rows."""
    dated = df.withColumns({partition: F.to_date(ts), "batch_id": F.lit(batch_id)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "batch_id").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own partition; a replay replaces it instead of adding."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_history(spark: SparkSession, path: str, partition: str = "log_date") -> DataFrame:
    """A history written by ``append_snapshot``; ``partition`` is a date and prunes."""
    df = spark.read.parquet(path)
    return df.withColumn(partition, F.col(partition).cast("date"))
