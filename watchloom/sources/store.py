"""Stored tables that a merge can publish its result to.

A table is cut into ranges of a key. Each range is a folder written by one commit, and the key-range map, a
small table with the least key and the folder of every range, says which folders are the table. A merge
finds the ranges that its batch meets, reads and rewrites those alone, writes a new map beside the old one and
then swaps the pointer file ``_current`` in one rename. Readers see the old table until then and the new one
from then on; a path being read is never written. What a stopped merge left behind is referred to by no map and
goes with ``remove_unreferenced``.

The driver holds the map, one row per range of about ``rows_per_range`` rows, as it holds any table's file list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from watchloom.operators.ranges import assign_boundaries
from watchloom.session import materialize

#: Rows that a range is cut for; ranges of more than twice as many are cut again by the merge that finds them.
ROWS_PER_RANGE = 2_000_000
_RANGE = "_range_no"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> dict | None:
    """The pointer: ``commit``, ``keys``, ``schema``, ``rows_per_range``; None where no table is published."""
    place, fs = _path(spark, path, "_current")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, state: dict, expected: str | None) -> None:
    """Point ``_current`` to ``state`` in one rename, unless another merge has been published since."""
    staged, fs = _path(spark, path, f"_next-{state['commit']}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    now = current(spark, path)
    if (now and now["commit"]) != expected:
        fs.delete(staged, False)
        raise RuntimeError(f"another merge was published to {path} meanwhile: merge again")
    jvm = spark._jvm.org.apache.hadoop.fs
    how = getattr(jvm, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    jvm.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, _path(spark, path, "_current")[0], options)


def range_map(spark: SparkSession, path: str) -> DataFrame:
    """(range_no, low, folder, n) of the published table; ``low`` is the struct of the key columns."""
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no published table at {path}")
    return spark.read.parquet(f"{path}/map/{state['commit']}")


def _rows(spark: SparkSession, state: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(state["schema"])).add(_RANGE, IntegerType())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The published table; a frame read before a merge goes on reading the table of that time."""
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no published table at {path}")
    folders = [r["folder"] for r in spark.read.parquet(f"{path}/map/{state['commit']}").select("folder").collect()]
    return _rows(spark, state, [f"{path}/data/{f}" for f in folders]).drop(_RANGE)


def create_table(df: DataFrame, path: str, keys: list[str], rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Publish ``df`` as a new table cut into ranges of ``keys``."""
    spark = df.sparkSession
    state = {"commit": uuid.uuid4().hex, "keys": keys, "schema": json.dumps(df.schema.jsonValue()), "rows_per_range": rows_per_range}
    written = materialize(df, "created")
    parts = max(1, -(-written.count() // rows_per_range))
    _write(_cut(written, keys, parts, 1), path, state["commit"], "0")
    _map_of(spark, path, state, ["0"]).write.parquet(f"{path}/map/{state['commit']}")
    _swap(spark, path, state, None)


def _cut(rows: DataFrame, keys: list[str], parts: int, first: int) -> DataFrame:
    """Rows numbered by ``parts`` ranges of the keys; equal keys are never parted."""
    dealt = rows.drop(_RANGE).repartitionByRange(parts, *[F.col(f"`{k}`") for k in keys])
    return dealt.withColumn(_RANGE, (F.spark_partition_id() + first).cast("int"))


def _write(rows: DataFrame, path: str, commit: str, round_no: str) -> None:
    rows.withColumn("range_dir", F.col(_RANGE)).write.partitionBy("range_dir").parquet(f"{path}/data/{commit}/{round_no}")


def _map_of(spark: SparkSession, path: str, state: dict, rounds: list[str]) -> DataFrame:
    """The map rows of what a commit has written: keys are scanned, nothing else."""
    out = None
    for r in rounds:
        _, fs = _path(spark, path)
        base = f"{path}/data/{state['commit']}/{r}"
        if not any(f.isDirectory() for f in fs.listStatus(_path(spark, base)[0])):
            continue
        low = F.min(F.struct(*[F.col(f"`{k}`") for k in state["keys"]])).alias("low")
        one = _rows(spark, state, [base + "/*"]).groupBy(F.col(_RANGE).alias("range_no")).agg(low, F.count(F.lit(1)).alias("n"))
        one = one.select("range_no", "low", F.concat(F.lit(f"{state['commit']}/{r}/range_dir="), F.col("range_no").cast("string")).alias("folder"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        schema = StructType.fromJson(json.loads(state["schema"]))
        low = StructType([schema[k] for k in state["keys"]])
        out = spark.createDataFrame([], StructType().add("range_no", IntegerType()).add("low", low).add("folder", StringType()).add("n", LongType()))
    return out


def publish_merge(spark: SparkSession, path: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], also: Column | None = None) -> dict:
    """Replace the stored table by ``merge(target, batch)``, reading only ranges that may change.

    Those are the ranges of the batch's keys and of stored rows that meet ``also``. ``merge`` gets the stored
    rows of these ranges, gives their next version, keeps a row's key, and passes columns that it doesn't know from
    either side to its result, as the operators of ``operators.sync`` do. Returns the numbers of ranges read
    and kept. A merge stopped at any point leaves the published table as it was; doing it again is safe.
    """
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no published table at {path}")
    known = spark.read.parquet(f"{path}/map/{state['commit']}")
    before = {r["range_no"]: r for r in known.orderBy("low").collect()}
    keys = F.struct(*[F.col(f"`{k}`") for k in state["keys"]])
    # The first range also takes what lies below it.
    placed = assign_boundaries(batch, keys, known.select("low"), "low", out="_place").withColumn("_place", F.greatest(F.col("_place") - 1, F.lit(1)))
    places = spark.createDataFrame([(i + 1, no) for i, no in enumerate(before)] or [(1, 1)], f"_place long, {_RANGE} int")
    numbered = materialize(placed.join(places, "_place").drop("_place"), "batch")
    touched = {r[0] for r in numbered.select(_RANGE).distinct().collect()}
    if also is not None:
        stored = _rows(spark, state, [f"{path}/data/{r['folder']}" for r in before.values()])
        touched |= {r[0] for r in stored.where(also).select(_RANGE).distinct().collect()}
    target = _rows(spark, state, [f"{path}/data/{r['folder']}" for no, r in before.items() if no in touched])
    columns = [F.col(f"`{c}`") for c in target.columns]
    after = state | {"commit": uuid.uuid4().hex}
    _write(merge(target, numbered).select(*columns), path, after["commit"], "0")
    found = {r["range_no"]: r for r in _map_of(spark, path, after, ["0"]).collect()}
    wide = [k for k, r in found.items() if r["n"] > 2 * state["rows_per_range"]]
    first, rounds = max([0, *before, *found]) + 1, []
    for i, k in enumerate(wide):
        parts = -(-found[k]["n"] // state["rows_per_range"])
        _write(_cut(_rows(spark, after, [f"{path}/data/{found[k]['folder']}"]), state["keys"], parts, first), path, after["commit"], str(i + 1))
        rounds.append(str(i + 1))
        first += parts
    written = _map_of(spark, path, after, ["0", *rounds])
    kept = spark.createDataFrame([r for no, r in before.items() if no not in touched], known.schema)
    kept.unionByName(written.where(~F.col("range_no").isin(wide)) if wide else written).coalesce(1).write.parquet(f"{path}/map/{after['commit']}")
    _swap(spark, path, after, state["commit"])
    return {"ranges_read": len(touched & set(before)), "ranges_kept": len(set(before) - touched), "commit": after["commit"]}


def remove_unreferenced(spark: SparkSession, path: str) -> int:
    """Delete folders of commits that the published map doesn't refer to; frames read from them fail afterwards.

    Not while a merge is being written: what it has written isn't referred to yet.
    """
    state = current(spark, path)
    live = {r["folder"] for r in range_map(spark, path).select("folder").collect()}
    removed = 0
    for commit in _names(spark, path, "data"):
        for r in _names(spark, path, "data", commit):
            for folder in _names(spark, path, "data", commit, r):
                if f"{commit}/{r}/{folder}" not in live:
                    place, fs = _path(spark, path, "data", commit, r, folder)
                    removed += fs.delete(place, True)
    for commit in _names(spark, path, "map"):
        if commit != state["commit"]:
            place, fs = _path(spark, path, "map", commit)
            fs.delete(place, True)
    return removed


def _names(spark: SparkSession, *parts: str) -> list[str]:
    place, fs = _path(spark, *parts)
    return [f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()] if fs.exists(place) else []
