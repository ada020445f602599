from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.functions.times import ntz

from conftest import SMALL
from watchloom.operators import sync as S
from watchloom.plans.sync import TAGS, publisher_items, subscriber_items

NOW = datetime(2024, 1, 1)


def test_second_sync_changes_nothing(spark):
    source = publisher_items(spark, SMALL)
    once = S.sync_items(subscriber_items(spark, SMALL), source, "PUB1", TAGS)
    assert {r.action for r in once.select("action").distinct().collect()} == {"INSERT", "UPDATE", "DELETE", "KEEP"}
    twice = S.sync_items(once.where("action <> 'DELETE'").drop("action"), source, "PUB1", TAGS)
    assert {r.action for r in twice.select("action").distinct().collect()} == {"KEEP"}


def test_strict_tags_delete_single_tag_rows_only(spark):
    cols = "item_id int, item_name string, tags string, checksum string, row_version int, publisher_name string, execution_result string"
    target = spark.createDataFrame([(1, "a", "X", "c", 1, "P", "SUCCEED"), (2, "b", "X,Y", "c", 1, "P", "SUCCEED")], cols)
    source = target.drop("publisher_name", "execution_result").where("false")
    loose = {r.item_id: r.action for r in S.sync_items(target, source, "P", ["X"]).collect()}
    strict = {r.item_id: r.action for r in S.sync_items(target, source, "P", ["X"], strict_tags=True).collect()}
    assert loose == {1: "DELETE", 2: "DELETE"} and strict == {1: "DELETE", 2: "KEEP"}


def test_marks_keep_their_value_without_newer_rows(spark):
    marks = spark.createDataFrame([("t", 50, 1, datetime(2023, 1, 1))], "table_name string, last_version long, table_order int, updated timestamp_ntz")
    out = S.update_watermarks(marks, {"t": (spark.range(10).toDF("v"), "v", 1)}, NOW)
    assert out.first().last_version == 50


def test_publish_defaults(spark):
    target = spark.createDataFrame([("a", "2.0", "T", "K", NOW, NOW)], "item_name string, item_version string, item_type string, tags string, create_date timestamp_ntz, update_date timestamp_ntz")
    incoming = spark.createDataFrame([("a", None, None, "N"), ("b", None, "U", None)], "item_name string, item_version string, item_type string, tags string")
    later = datetime(2024, 2, 2)
    out = {(r.item_name, r.item_version): (r.item_type, r.tags, r.create_date, r.update_date) for r in S.publish_items(target, incoming, later).collect()}
    assert out == {("a", "2.0"): ("T", "N", NOW, later), ("b", "1.0"): ("U", "TSX", later, later)}
    no = {(r.item_name, r.item_version) for r in S.publish_items(target, incoming, later, replace=False).collect()}
    assert no == {("a", "2.0"), ("a", "1.0"), ("b", "1.0")}


def test_pull_into_an_empty_copy(spark):
    src = spark.createDataFrame([(1, 5, "X"), (2, 0, "X"), (3, 9, "Y")], "id int, v int, a string")
    out = S.incremental_pull(src, src.where("false"), ["X"], "id", "v", "a")
    assert [r.id for r in out.collect()] == [1]
    assert S.incremental_pull(src, src.where("false"), ["X"], "id", "v", "a", use_version=False).count() == 2


def log(spark, rows):
    return spark.createDataFrame(rows, "database string, record_id long, record_ref long, status string, is_usable boolean")


def test_drift_states(spark):
    rows = [("a", 1, None, "SUCCEED", True), ("a", 2, None, None, True), ("a", 3, None, "SUCCEED", True), ("b", 1, None, "SUCCEED", True), ("c", 1, None, None, True)]
    declared = spark.createDataFrame([("a", 2), ("c", 1), ("d", 4)], "database string, version long")
    drift = S.version_drift(log(spark, rows), declared)
    out = {r.database: (r.state, r.contiguous_version, r.max_version) for r in drift.collect()}
    assert out == {"a": ("AHEAD", 1, 3), "b": ("MISSING_DECLARATION", 1, 1), "c": ("AHEAD", None, None), "d": ("AHEAD", None, None)}
    acts = {(r.database, r.record_id): r.action for r in S.drift_actions(log(spark, rows), drift).collect()}
    assert acts == {("a", 2): "CANCEL", ("c", 1): "CANCEL"}


def test_replay_needs_every_base(spark):
    rows = [("a", 1, None, "SUCCEED", True), ("a", 2, None, "SUCCEED", True), ("a", 3, 1, "SUCCEED", True), ("b", 5, None, "SUCCEED", True)]
    ok = spark.createDataFrame([("a", 1)], "database string, version long")
    acts = S.drift_actions(log(spark, rows), S.version_drift(log(spark, rows), ok)).collect()
    assert [(r.record_id, r.action) for r in acts] == [(2, "REPLAY")]
    missing = spark.createDataFrame([("a", 1), ("b", 4)], "database string, version long")
    assert S.drift_actions(log(spark, rows), S.version_drift(log(spark, rows), missing)).count() == 0


def test_soft_delete_touches_only_its_rows(spark):
    t = spark.range(4).select("id", F.lit(True).alias("is_enabled"), ntz(datetime(2020, 1, 1)).alias("update_date"))
    out = S.soft_delete(t, t.where("id = 2"), ["id"], NOW).orderBy("id").collect()
    assert [r.is_enabled for r in out] == [True, True, False, True] and out[2].update_date == NOW


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in S.upsert(a, b, ["k"]).collect()) == [(1, "x"), (2, None), (3, "z")]


def test_changed_and_unknown_checksums_do_not_run(spark):
    from watchloom.functions.numbers import fingerprint

    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", True), (4, "d", False)], "i int, t string, e boolean")
    df = df.withColumn("c", F.when(F.col("i") != 3, fingerprint("t"))).withColumn("t", F.when(F.col("i") == 2, "edited").otherwise(F.col("t")))
    out = {r.i: (r.state, r.may_run) for r in S.checksum_drift(df, "c", ["t"], F.col("e")).collect()}
    assert out == {1: ("MATCH", True), 2: ("CHANGED", False), 3: ("MISSING", False), 4: ("MATCH", False)}


def test_copy_goes_on_after_a_failure(spark, tmp_path):
    from watchloom.operators.tables import copy_tables

    good = spark.range(10).withColumn("p", F.col("id") % 3)
    bad = good.withColumn("x", F.when(F.col("p") == 2, F.raise_error(F.lit("broken"))).otherwise(1))
    where = {"dst": str(tmp_path / "dst"), "ledger": str(tmp_path / "ledger"), "parallel": 1}
    with pytest.raises(Exception, match="broken"):
        copy_tables(spark, {"a": good.drop("p"), "b": bad.drop("p"), "c": bad}, partition_by={"c": ["p"]}, **where)
    mended = good.withColumn("x", F.lit(1))
    first = {r.object_name for r in spark.read.parquet(where["ledger"] + "/*").collect()}
    assert "a" in first and "b" not in first
    boom = spark.range(1).select(F.raise_error(F.lit("copied twice")).alias("id"))
    report = copy_tables(spark, {"a": boom, "b": mended, "c": mended}, partition_by={"c": ["p"]}, **where).collect()
    assert {r.object_name: r.row_count for r in report} == {"a": 10, "b": 10, "c": 10}
    assert spark.read.parquet(where["dst"] + "/c").count() == 10 and spark.read.parquet(where["dst"] + "/a").count() == 10


def test_a_stopped_copy_goes_on_after_its_last_piece(spark, tmp_path, monkeypatch):
    from watchloom.operators import tables as T

    dst, ledger = str(tmp_path / "dst"), str(tmp_path / "ledger")
    rows = [(i, None if i % 5 == 4 else f"a/b {i % 5}#%") for i in range(50)]
    source = spark.createDataFrame(rows, "id long, p string")
    publish, moved = T._publish_piece, []

    def stop(*args):
        if len(moved) == 3:
            raise KeyboardInterrupt
        moved.append(args)
        publish(*args)

    with monkeypatch.context() as m:
        m.setattr(T, "_publish_piece", stop)
        with pytest.raises(KeyboardInterrupt):
            T.copy_tables(spark, {"t": source}, dst, partition_by={"t": ["p"]}, ledger=ledger, parallel=1)
    finished = {r.piece for r in spark.read.parquet(ledger + "/*").collect()}
    assert len(finished) == 3 and spark.read.parquet(dst + "/t").count() == 30
    again = F.coalesce(F.col("p"), F.lit("None")).isin(list(finished))
    careful = source.withColumn("id", F.when(again, F.raise_error(F.lit("copied twice"))).otherwise(F.col("id")))
    for given in (careful, careful.where("false")):
        report = T.copy_tables(spark, {"t": given}, dst, partition_by={"t": ["p"]}, ledger=ledger).first()
        assert report.row_count == 50
        got = spark.read.schema("id long, p string").parquet(dst + "/t").collect()
        assert sorted((r.id, r.p) for r in got) == sorted(rows, key=lambda r: r[0])
    assert not (tmp_path / "dst" / "_staged" / "t").exists()


def test_a_partitioned_copy_scans_its_source_once(spark, tmp_path):
    from watchloom.operators.tables import copy_tables

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(300).selectExpr("id", "id % 20 AS p").mapInArrow(count, "id long, p long")
    copy_tables(spark, {"t": source}, str(tmp_path / "dst"), partition_by={"t": ["p"]}, ledger=str(tmp_path / "ledger"))
    assert seen.value == 300
