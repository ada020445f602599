import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.operators import sync as S
from watchloom.operators.ranges import assign_boundaries
from watchloom.sources import store as T


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    T.create_table(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, ["k"], 100)
    return path


def upsert(target, batch):
    return S.upsert(target, batch, ["k"])


def content(spark, path):
    return {r.k: r.v for r in T.read_table(spark, path).collect()}


def test_a_merge_touches_the_ranges_of_its_batch_only(spark, table):
    folders = {r.range_no: r.folder for r in T.range_map(spark, table).collect()}
    assert len(folders) == 10
    report = T.publish_merge(spark, table, spark.createDataFrame([(5, "new"), (7, "new"), (-3, "new"), (995, "new"), (5000, "new")], "k long, v string"), upsert)
    assert (report["ranges_read"], report["ranges_kept"]) == (2, 8)
    after = {r.range_no: r.folder for r in T.range_map(spark, table).collect()}
    assert sum(after[k] == folders[k] for k in folders) == 8
    got = content(spark, table)
    assert len(got) == 1002 and {k for k, v in got.items() if v == "new"} == {5, 7, -3, 995, 5000}
    files = T.read_table(spark, table).inputFiles()
    assert sum(report["commit"] in f for f in files) < len(files) / 2


def test_untouched_ranges_are_not_read(spark, table, monkeypatch):
    """Their files are gone, and the merge doesn't miss them."""
    import shutil

    for r in T.range_map(spark, table).collect():
        if r.low["k"] >= 500:
            shutil.move(f"{table}/data/{r.folder}", f"{table}-aside-{r.range_no}")
    assert T.publish_merge(spark, table, spark.createDataFrame([(1, "new")], "k long, v string"), upsert)["ranges_read"] == 1


def test_a_merge_stopped_before_the_swap_leaves_the_old_table(spark, table, monkeypatch):
    batch = spark.createDataFrame([(5, "new")], "k long, v string")
    before = T.read_table(spark, table)

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(T, "_swap", stop)
        with pytest.raises(KeyboardInterrupt):
            T.publish_merge(spark, table, batch, upsert)
    assert content(spark, table)[5] == "old"
    for _ in range(2):
        T.publish_merge(spark, table, batch, upsert)
        assert content(spark, table)[5] == "new"
    assert {r.v for r in before.where("k = 5").collect()} == {"old"}  # as of the time it was read
    assert T.remove_unreferenced(spark, table) >= 2
    assert content(spark, table)[5] == "new" and len(glob.glob(f"{table}/map/*")) == 1


def test_two_merges_at_once_do_not_lose_one(spark, table):
    def slow(target, batch):
        T.publish_merge(spark, table, spark.createDataFrame([(6, "other")], "k long, v string"), upsert)
        return upsert(target, batch)

    with pytest.raises(RuntimeError, match="merge again"):
        T.publish_merge(spark, table, spark.createDataFrame([(5, "new")], "k long, v string"), slow)
    assert content(spark, table)[6] == "other" and content(spark, table)[5] == "old"


def test_growing_ranges_are_cut_and_empty_ones_go(spark, table):
    T.publish_merge(spark, table, spark.range(1000, 1700).select(F.col("id").alias("k"), F.lit("new").alias("v")), upsert)
    ranges = T.range_map(spark, table).orderBy("low").collect()
    assert len(ranges) > 15 and all(r.n <= 200 for r in ranges) and sum(r.n for r in ranges) == 1700
    assert [r.low["k"] for r in ranges] == sorted(r.low["k"] for r in ranges)
    gone = spark.range(1700).select(F.col("id").alias("k"))
    T.publish_merge(spark, table, gone, lambda target, batch: target.join(batch.select("k"), "k", "left_anti"))
    assert content(spark, table) == {} and T.range_map(spark, table).count() == 0
    T.publish_merge(spark, table, spark.createDataFrame([(5, "new")], "k long, v string"), upsert)
    assert content(spark, table) == {5: "new"}


def test_rows_that_may_go_without_a_batch_row(spark, table):
    none = spark.createDataFrame([], "k long, v string")
    report = T.publish_merge(spark, table, none, lambda target, batch: target.where("k NOT BETWEEN 250 AND 260"), F.col("k").between(250, 260))
    assert report["ranges_read"] == 1 and len(content(spark, table)) == 989


def test_soft_delete_and_publish_on_a_table(spark, tmp_path):
    path, now = str(tmp_path / "items"), datetime(2024, 2, 2)
    items = spark.createDataFrame([("a", "1.0", "T", "K", now, now), ("a", "2.0", "T", "K", now, now), ("b", "1.0", "T", "K", now, now)], "item_name string, item_version string, item_type string, tags string, create_date timestamp_ntz, update_date timestamp_ntz")
    T.create_table(items, path, ["item_name"], 1)
    asked = spark.createDataFrame([("a", None, "N", None), ("c", None, None, None)], "item_name string, item_version string, item_type string, tags string")
    T.publish_merge(spark, path, asked, lambda t, s: S.publish_items(t, s, now))
    got = sorted((r.item_name, r.item_version, r.item_type) for r in T.read_table(spark, path).collect())
    assert got == [("a", "1.0", "T"), ("a", "2.0", "N"), ("b", "1.0", "T"), ("c", "1.0", None)]


def test_boundaries_of_many_entities(spark):
    import bisect
    import random

    r = random.Random(3)
    edges = [(e, r.randrange(100)) for e in ("a", "b", None) for _ in range(40)] + [("x", None)]
    rows = [(i, r.choice(["a", "a", "a", "b", None, "none"]), r.choice([None, 50, *range(-5, 110)])) for i in range(2000)] + [(5000 + i, "a", 50) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, e string, v int")
    b = spark.createDataFrame(edges, "e string, boundary int")
    for right in (True, False):
        out = {x.i: x.no for x in assign_boundaries(df, "v", b, by=["e"], right=right, out="no").collect()}
        side = bisect.bisect_right if right else bisect.bisect_left
        for i, e, v in rows:
            own = sorted({x for k, x in edges if k == e and x is not None})
            assert out[i] == (None if v is None else 1 + side(own, v))
    plan = assign_boundaries(df, "v", b, by=["e"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
