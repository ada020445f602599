"""Session helpers: table loading, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_root: dict[str, str] = {}


def build_session(app: str = "watchloom", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local work; on a cluster use the session the cluster provides."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a private folder: on a cluster a machine-local
    folder would be invisible to the other executors, so the missing setting is an error.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_KEY} must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="watchloom-")
    return _local_root[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path; all paths of one application share a folder, to be purged after it."""
    return f"{scratch_root(spark)}/watchloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def purge_scratch(spark: SparkSession) -> None:
    """Delete all intermediates of this application; frames that still read them fail afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/watchloom-{spark.sparkContext.applicationId}")
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def read_like(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and return a scan of it.

    Cuts lineage, survives executor loss, and leaves exact file sizes for the planner, so
    Spark itself decides from the real size whether a later join side may be broadcast.
    """
    return materialize_counted(df, label)[0]


def materialize_counted(df: DataFrame, label: str, where: str | None = None) -> tuple[DataFrame, int, str]:
    """As ``materialize``; the number of rows, or of those meeting ``where``, comes from the same job."""
    met = F.lit(1) if where is None else F.when(F.expr(where), 1)
    table, seen = materialize_observed(df, label, n=F.count(met))
    return table, int(seen["n"]), seen["_path"]


def materialize_observed(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates over the rows from the same job, and ``_path``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).write.parquet(path)
    return read_like(spark, [path], df.schema), dict(seen.get) | {"_path": path}
