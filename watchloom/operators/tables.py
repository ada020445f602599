"""Table-set operators: key choice, inventory, copying, clearing, permissions."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from watchloom.operators.ranking import choose_best
from watchloom.session import materialize


def choose_keys(index_cols: DataFrame) -> DataFrame:
    """Best unique column set per object: most columns shared with the clustered key, then
    fewest columns, then shortest.

    ``index_cols``: (object_id, group_id, in_cluster, column_length), one row per column of
    a unique set; an unknown length counts as 1 000 000.
    """
    stats = index_cols.groupBy("object_id", "group_id").agg(
        F.sum(F.col("in_cluster").cast("long")).alias("cluster_columns"),
        F.count(F.lit(1)).alias("columns"),
        F.sum(F.coalesce(F.col("column_length").cast("long"), F.lit(1_000_000))).alias("total_length"),
    )
    order = [F.col("cluster_columns").desc(), F.col("columns"), F.col("total_length"), F.col("group_id")]
    return choose_best(stats, "object_id", order)


def table_inventory(
    columns: DataFrame, index_columns: DataFrame, foreign_keys: DataFrame, by: list[str] | None = None, rows_per_chunk: int | None = None
) -> DataFrame:
    """One row per table: its columns, key flags and names, and its load order.

    Object ids are local to a server or database: with ``by`` all three tables meet on it
    too. The column list is a table's own definition and bounded by it; for lists without a bound
    ``rows_per_chunk`` gives them in numbered chunks, one row each.

    ``columns``: (object_id, column_id, column_name, is_identity, is_rowguid, is_filestream,
    is_sparse, is_lob); ``index_columns``: (object_id, index_id, kind PK / UQ / UX,
    column_name, key_ordinal) without disabled or filtered indexes; ``foreign_keys``:
    (master, slave). Tables on a key cycle keep their row with a null order.
    """
    from watchloom.operators.aggregates import column_profile, concat_rows, joined_values, profile_values
    from watchloom.operators.graph import topo_levels

    by = list(by or [])
    table = [*by, "object_id"]
    names = ["identity", "rowguid", "filestream", "sparse", "lob"]
    flags = columns.withColumnsRenamed({f"is_{f}": f for f in names})
    if rows_per_chunk:
        listed = concat_rows(columns, table, "column_name", ",", ["column_id"], "table_columns", rows_per_chunk)
        listed = listed.join(column_profile(flags, table, names).drop("lob_column"), table)
        ids = columns.select(*table).distinct()
    else:
        # List, flags and the tables themselves from one pass over the columns, written once.
        # The id leads: rows of a task are sorted by it, and servers repeat in every row.
        flags = flags.repartition(*table).groupBy("object_id", *by).agg(joined_values("column_name", ",", ["column_id"]).alias("table_columns"), *profile_values(names))
        every = materialize(flags.select(*table, *[c for c in flags.columns if c not in (*table, "lob_column")]), "tables")
        listed, ids = every.dropna(subset=table), every.select(*table)
    # Dealt by table once, for the sets and for the choice among them.
    sets = index_columns.repartition(*table).groupBy("object_id", "index_id", "kind", *by).agg(joined_values("column_name", ",", ["key_ordinal"]).alias("cols"))
    keys = sets.groupBy(*table).agg(
        *[F.min(F.when(F.col("kind") == k, F.col("cols"))).alias(name) for k, name in (("PK", "pk_columns"), ("UQ", "uq_columns"), ("UX", "ux_columns"))]
    )
    levels = topo_levels(foreign_keys, ids, by=by).select(
        *by, F.col("node").alias("object_id"), F.col("level").alias("table_order")
    )
    out = listed.join(keys, table, "left").join(levels, table, "left")
    return out.withColumns(
        {f"has_{short}": F.col(c).isNotNull() for short, c in (("pk", "pk_columns"), ("uq", "uq_columns"), ("ux", "ux_columns"))}
    )


def copy_tables(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    dst: str,
    except_: tuple[str, ...] = (),
    skip_columns: dict[str, list[str]] | None = None,
    sort_keys: dict[str, list[str]] | None = None,
    partition_by: dict[str, list[str]] | None = None,
    batch_rows: int = 10_000,
    ledger: str | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Copy tables to ``dst`` and report (object_name, columns, row_count, batch_count, size_kb).

    The loop is over tables, never rows; up to ``parallel`` tables are copied at a time, each in one scan. Computed and row-version columns named in ``skip_columns`` stay behind. Files are
    sorted on the table's best key inside each task: narrow value ranges per file without a
    shuffle. Row counts come from the copying job.

    With a ``ledger`` folder every finished piece is recorded there: a table, or one value of
    the first partition column of a partitioned table. A partitioned table is written aside whole, then
    its pieces are moved into place one by one, each followed by its row of the ledger, by renames alone. A
    repeated call filters the pieces already recorded at the scan, and a piece that was interrupted is
    replaced as a whole. One copy of a table runs at a time.
    """
    done = _ledger_rows(spark, ledger)

    def copy(name: str) -> tuple:
        df, by = sources[name], (partition_by or {}).get(name) or []
        kept = [c for c in df.columns if c not in (skip_columns or {}).get(name, [])]
        sort = (sort_keys or {}).get(name)
        if ledger and by:
            rows = _copy_pieces(spark, df, kept, name, dst, by, sort, ledger, {piece: n for (table, piece), n in done.items() if table == name})
        elif (name, "") in done:
            rows = done[name, ""]
        else:
            rows = _copy_whole(df.select(*kept), f"{dst}/{name}", by, sort)
            if ledger:
                spark.createDataFrame([(name, "", rows)], _LEDGER).coalesce(1).write.parquet(f"{ledger}/{uuid.uuid4().hex}")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        size = files.load(f"{dst}/{name}").agg(F.sum("length")).first()[0]
        batches = -(-rows // batch_rows) if batch_rows > 0 else 1
        return (name, ",".join(kept), rows, batches, (size or 0) // 1024)

    names = [n for n in sources if n not in except_]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        report = list(pool.map(copy, names))
    return spark.createDataFrame(report, "object_name string, columns string, row_count long, batch_count long, size_kb long")


_LEDGER = "object_name string, piece string, row_count long"
#: The piece of rows without a value.
_NO_VALUE = "None"


def _ledger_rows(spark: SparkSession, ledger: str | None) -> dict[tuple[str, str], int]:
    """(table, piece) to rows of the pieces copied so far; each has a folder of its own, so copies don't meet."""
    if not ledger:
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return {(r["object_name"], r["piece"]): r["row_count"] for r in spark.read.schema(_LEDGER).parquet(f"{ledger}/*").collect()}


def _copy_whole(df: DataFrame, path: str, by: list[str], sort: list[str] | None) -> int:
    out = df.sortWithinPartitions(*sort) if sort else df
    seen = Observation()
    writer = out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return int(seen.get["n"])


def _copy_pieces(
    spark: SparkSession, df: DataFrame, kept: list[str], name: str, dst: str, by: list[str], sort: list[str] | None, ledger: str, done: dict[str, int]
) -> int:
    """Copy what the ledger doesn't hold yet in one scan; the number of rows of all pieces."""
    column, kind = F.col(by[0]), df.schema[by[0]].dataType
    values = [F.lit(piece).cast(kind) for piece in done if piece != _NO_VALUE]
    rest = df.where(~column.isin(values) | (column.isNull() if _NO_VALUE not in done else F.lit(False))) if values else df
    rest = rest.where(column.isNotNull()) if _NO_VALUE in done and not values else rest
    root, fs = _place(spark, f"{dst}/_staged/{name}")
    fs.delete(root, True)  # of a copy that was stopped
    staged, rows = f"{dst}/_staged/{name}/rows", f"{dst}/_staged/{name}/ledger"
    out = rest.select(*kept)
    (out.sortWithinPartitions(*sort) if sort else out).write.partitionBy(*by).parquet(staged)
    fs.mkdirs(_place(spark, f"{dst}/{name}")[0])
    pieces = [f.getPath().getName() for f in fs.listStatus(_place(spark, staged)[0]) if f.isDirectory()]
    total = sum(done.values())
    if pieces:
        schema = df.select(*kept).schema
        written = spark.read.schema(schema).parquet(staged)
        # Names of the ledger's folders are spelled as those of the pieces: both are the same value.
        counts = written.groupBy(by[0]).agg(F.count(F.lit(1)).alias("row_count"))
        piece = F.coalesce(column.cast("string"), F.lit(_NO_VALUE)).alias("piece")
        counts.select(F.lit(name).alias("object_name"), piece, "row_count", column.alias("_piece")).coalesce(1).write.partitionBy("_piece").parquet(rows)
        total += spark.read.parquet(rows).agg(F.sum("row_count")).first()[0]
    for folder in pieces:
        _publish_piece(spark, f"{staged}/{folder}", f"{dst}/{name}/{folder}", f"{rows}/_piece={folder.partition('=')[2]}", ledger)
    fs.delete(root, True)
    return total


def _publish_piece(spark: SparkSession, staged: str, path: str, row: str, ledger: str) -> None:
    """Move a piece into place, then its row into the ledger: stopped between the two, it is copied again."""
    (target, fs), (folder, _) = _place(spark, path), _place(spark, ledger)
    fs.delete(target, True)
    fs.mkdirs(folder)
    for source, to in ((staged, path), (row, f"{ledger}/{uuid.uuid4().hex}")):
        if not fs.rename(_place(spark, source)[0], _place(spark, to)[0]):
            raise OSError(f"{source} could not be moved to {to}")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())



def clear_partition(spark: SparkSession, path: str, partition: str) -> None:
    """Empty one ``column=value`` partition of a partitioned table, leaving the others alone."""
    part_path = f"{path}/{partition}"
    schema = spark.read.parquet(part_path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(part_path)


def permission_report(members: DataFrame, grants: DataFrame, principals: DataFrame, logins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, database, principal, kind, name, state, object): role memberships and explicit grants.

    Databases, principals and logins are local to a server: with ``by`` they meet on it too.

    ``principals``: (database, principal_id, name, type, sid). Only principals with a login
    count; the owner's memberships and plain connect rights are left out.
    """
    by = list(by or [])
    db = [*by, "database"]
    p = principals.join(logins.select(*by, "sid").distinct(), [*by, "sid"], "left_semi")
    users = p.select(*db, F.col("principal_id").alias("member_id"), F.col("name").alias("principal")).where("principal <> 'dbo'")
    roles = principals.where("type = 'R'").select(*db, F.col("principal_id").alias("role_id"), F.col("name").alias("name"))
    by_role = members.join(users, [*db, "member_id"]).join(roles, [*db, "role_id"])
    by_role = by_role.select(*db, "principal", F.lit("ROLE").alias("kind"), "name", F.lit("MEMBER").alias("state"), F.lit(None).cast("string").alias("object"))
    grantees = p.select(*db, F.col("principal_id").alias("grantee_id"), F.col("name").alias("principal"))
    explicit = grants.where("type <> 'CO'").join(grantees, [*db, "grantee_id"])
    explicit = explicit.select(*db, "principal", F.lit("GRANT").alias("kind"), F.col("permission").alias("name"), "state", "object")
    return by_role.unionByName(explicit)
