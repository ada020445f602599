from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.operators import filters as FL
from watchloom.operators.aggregates import counter_delta, day_pivot, group_incidents, share_profile
from watchloom.operators.joins import assign_range, only_kind_recently, orphans, resolve_items
from watchloom.operators.lifecycle import kinds_of, size_forecast
from watchloom.operators.ranking import ordinal, range_batches, with_group_max
from watchloom.operators.rules import Rule, run_rules


def test_default_window():
    lo, hi = FL.default_window(datetime(2024, 1, 30, 9, 30))
    assert (lo, hi) == (datetime(2024, 1, 29), datetime(2024, 1, 30, 23, 59, 59))


def test_deny_list_size():
    assert len(FL.BENIGN_WAITS) == len(set(FL.BENIGN_WAITS)) == 61


def catalog(spark):
    names = [
        ("master", True), ("model", True), ("tempdb", True), ("depot", True), ("Sales", False), ("stock", False), ("other", False),
    ]
    cols = "name string, is_system boolean, is_mirror boolean, state string, is_snapshot boolean, is_read_only boolean, replica_role string"
    return spark.createDataFrame([(n, s, False, "ONLINE", False, False, None) for n, s in names], cols)


def test_selector_example(spark):
    expr = "<ALL_SYSTEM_DATABASES><INCLUDE:Sales><EXCLUDE:tempdb,depot>"
    out = {r.name for r in FL.select_entities(catalog(spark), expr).collect()}
    assert out == {"master", "model", "Sales"}


def test_selector_plain_list(spark):
    assert {r.name for r in FL.select_entities(catalog(spark), "OTHER,nope").collect()} == {"other"}
    loose = FL.select_entities(catalog(spark), "OTHER,nope", validate=False)
    assert {r.name for r in loose.collect()} == {"other", "nope"}


def test_share_of_a_single_category_is_one_hundred(spark):
    df = spark.createDataFrame([("A", 1000, 100, 4), ("B", 0, 0, 0)], "k string, t long, s long, n long")
    out = share_profile(df, "k", "t", "s", "n").collect()
    assert len(out) == 1 and float(out[0].percentage) == 100.0 and float(out[0].avg_wait_sec) == 0.25


def test_share_counts_dropped_rows_in_the_total(spark):
    df = spark.createDataFrame([("A", 500, 0, 1), ("B", 500, 0, 0), ("WAITFOR", 9000, 0, 1)], "k string, t long, s long, n long")
    out = {r.k: float(r.percentage) for r in share_profile(df, "k", "t", "s", "n").collect()}
    assert out == {"A": 50.0}


def test_counter_delta(spark):
    h = [(1, datetime(2024, 1, 1), "a", 10), (1, datetime(2024, 1, 1), "gone", 5), (2, datetime(2024, 1, 1, 1), "a", 4), (2, datetime(2024, 1, 1, 1), "new", 7)]
    df = spark.createDataFrame(h, "s long, t timestamp_ntz, e string, c long").withColumn("d", F.to_date("t"))
    for part in (None, "d"):
        out = {r.e: (r.c, r.is_reset, r.duration_sec) for r in counter_delta(df, "s", "t", ["e"], ["c"], part).collect()}
        assert out == {"a": (-6, True, 3600), "new": (7, False, 3600)}
    assert counter_delta(df.where("s = 1"), "s", "t", ["e"], ["c"]).count() == 0
    assert counter_delta(df.where("s > 5"), "s", "t", ["e"], ["c"]).count() == 0


def test_day_pivot_keeps_groups_outside_its_days(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 31)), ("a", datetime(2024, 1, 30)), ("b", datetime(2024, 1, 1))], "k string, t timestamp_ntz")
    out = {r.k: tuple(r)[1:] for r in day_pivot(df, ["k"], "t", datetime(2024, 1, 31), 2).collect()}
    assert out == {"a": (1, 1, None), "b": (None, None, None)}


def test_incident_means_truncate(spark):
    df = spark.createDataFrame([("x", 1500, "p1"), ("x", 2500, "p2"), ("y", None, "q")], "t string, d long, p string")
    out = {r.factors: (r.occurrence, r.total_ms, r.average_ms, r.sample) for r in group_incidents(df, "t", "d", "p").collect()}
    assert out == {"x": (2, 4, 2, "p2"), "y": (1, None, None, "q")}


def test_orphans_ignore_nulls(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (None,)], "pk int")
    assert [r.fk for r in orphans(child, parent, "fk", "pk").collect()] == [2]


def test_only_kind(spark):
    rows = [("a", 2, datetime(2024, 1, 5)), ("b", 2, datetime(2024, 1, 5)), ("b", 7, datetime(2024, 1, 6)), ("c", 7, datetime(2023, 1, 1)), ("c", 2, datetime(2024, 1, 6))]
    df = spark.createDataFrame(rows, "db string, kind int, t timestamp_ntz")
    out = only_kind_recently(df, "db", F.col("kind") == 2, "t", 7, datetime(2024, 1, 8))
    assert {r.db for r in out.collect()} == {"a", "c"}


@pytest.mark.parametrize("right, expected", [(True, [1, 2, 2, 3]), (False, [1, 1, 2, 2])])
def test_range_bounds(spark, right, expected):
    df = spark.createDataFrame([(9,), (10,), (15,), (20,)], "v int")
    assert [r.partition_no for r in assign_range(df, "v", [20, 10], right).orderBy("v").collect()] == expected


def test_resolve_items_wildcards(spark):
    items = spark.createDataFrame(
        [(1, "a", "9.0", "p", 1), (2, "a", "10.0", "p", 2), (3, "a", "8.0", "q", 3)],
        "item_id int, item_name string, item_version string, publisher_name string, update_date int",
    )
    asked = [(1, "a", "LATEST", None), (2, "a", " ", "q"), (3, "a", "10.0", "p"), (4, "a", None, "p"), (5, "a", "7.0", None), (6, "zz", None, None)]
    req = spark.createDataFrame(asked, "request_id int, item_name string, item_version string, publisher_name string")
    assert {r.request_id: r.item_id for r in resolve_items(req, items).collect()} == {1: 1, 2: 3, 3: 2, 4: 1}
    assert {r.request_id: r.item_id for r in resolve_items(req, items, numeric_versions=True).collect()} == {1: 2, 2: 3, 3: 2, 4: 2}


def test_positions_with_a_hot_key(spark):
    """Two thirds of the rows share a key, which then spans several range partitions."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    out = ordinal(df.repartition(7), ["k"], ["id"]).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.k, r.id)):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.ordinal == seen[r.k]
    assert len(out) == 3000 and seen["hot"] == 2000


def test_positions_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, v int")
    assert sorted((r.v, r.ordinal) for r in ordinal(df, ["k"], ["v"]).collect()) == [(1, 1), (2, 2), (5, 1)]


def test_batches(spark):
    df = spark.range(95).repartition(5)
    out = range_batches(df, "id", 10).collect()
    assert all(r.batch_no == r.id // 10 + 1 for r in out)


def test_group_max_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in with_group_max(df, ["k"], "v", "m").collect()) == [("a", 1, 3), ("a", 3, 3), ("b", 2, 2)]


def test_kinds():
    assert kinds_of("FULL,LOG") == ["D", "L"] and kinds_of("") == ["D", "L", "I"] and kinds_of("all") == ["D", "L", "I"]


def test_file_counts(spark):
    history = spark.createDataFrame([], "entity string, kind string, size double, compressed_size double, finish int, is_damaged boolean, is_incomplete boolean")
    ent = spark.createDataFrame([("tiny", "D", 0), ("one", "D", 80), ("odd", "D", 90), ("huge", "D", 10**6)], "entity string, kind string, row_gb long")
    ent = ent.withColumns({"filestream_gb": F.lit(0), "log_gb": F.lit(0), "is_compressed": F.lit(False)})
    out = {r.entity: r.file_count for r in size_forecast(history, ent, 80, 2).collect()}
    assert out == {"tiny": 2, "one": 2, "odd": 2, "huge": 64}
    assert {r.file_count for r in size_forecast(history, ent, 0, 2).collect()} == {1}


def test_rules_report_states(spark):
    t = {"t": spark.createDataFrame([(1,), (-1,)], "v int")}
    rules = [Rule(1, "c", "neg", "t", "v < 0"), Rule(2, "c", "big", "t", "v > 9"), Rule(3, "c", "gone", "nope", "true")]
    full = {r.code: r.result for r in run_rules(t, rules, issues_only=False).collect()}
    assert full == {1: "Possible issue found (1)", 2: "OK", 3: "Not supported"}
    assert [r.code for r in run_rules(t, rules).collect()] == [1, 3]
    assert run_rules(t, rules[:1], language="pt").first().result == "Possível problema encontrado (1)"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_rule_hits_and_misses(spark, sf):
    """On the fixture each rule has offenders, is supported, explains itself, and leaves other rows alone."""
    from watchloom.operators.rule_packs import posture_pack
    from watchloom.plans.adapters import orders_as_of
    from watchloom.plans.rules import inventory

    pack, tables = posture_pack(orders_as_of(spark, sf)), inventory(spark, sf)
    report = run_rules(tables, pack, issues_only=False).collect()
    assert len(report) == len(pack) and {r.code for r in report if not r.issues} == set()
    assert all(r.how_to_fix for r in report) and all(p.labels["pt"] for p in pack)
    sizes = {t: df.count() for t, df in tables.items()}
    rows = {p.code: sizes[p.table] for p in pack if p.table}
    assert all(r.issues < rows[r.code] for r in report if r.code in rows)


def test_rules_stay_on_their_server(spark):
    from watchloom.operators.rule_packs import policy_pack, posture_pack

    pack = {r.code: r for r in posture_pack(datetime(2024, 1, 1))}
    logins = spark.createDataFrame([("A", 1), ("B", 2)], "server string, sid long")
    users = spark.createDataFrame([("A", "d", 9, "u", "S", "INSTANCE", 1), ("B", "d", 9, "u", "S", "INSTANCE", 1)], "server string, database string, user_id long, name string, type string, auth string, sid long")
    assert [r.server for r in pack[102].build({"db_users": users, "logins": logins}).collect()] == ["B"]
    grants = [("A", "boss", "Control server", "G", "SERVER", "x"), ("A", "mate", "IMPERSONATE", "G", "SERVER_PRINCIPAL", "boss"), ("B", "mate", "IMPERSONATE", "G", "SERVER_PRINCIPAL", "boss")]
    perms = spark.createDataFrame(grants, "server string, grantee string, permission string, state string, class string, target string")
    members = spark.createDataFrame([], "server string, database string, role string, member string")
    out = pack[404].build({"server_permissions": perms, "role_members": members}).collect()
    assert sorted((r.server, r.login) for r in out) == [("A", "boss"), ("A", "mate")]
    servers = spark.createDataFrame([("A",), ("B",)], "server string")
    flags = spark.createDataFrame([("A", 1118, True), ("B", 1118, False)], "server string, flag int, is_global boolean")
    rule = next(r for r in policy_pack() if r.code == 1002)
    assert [r.server for r in rule.build({"trace_flags": flags, "servers": servers}).collect()] == ["B"]


def test_totals_have_room(spark):
    df = spark.createDataFrame([("A", "w", 10**17, 0, 1)] * 3 + [("B", "w", 1000, 0, 1)], "server string, k string, t long, p long, n long")
    out = {r.server: (int(r.wait_sec), int(r.percentage)) for r in share_profile(df, "k", "t", "p", "n", [], ["server"]).collect()}
    assert out == {"A": (3 * 10**14, 100), "B": (1, 100)}


def test_servers_keep_their_own_snapshots(spark):
    at = [datetime(2024, 1, 1, 0, m, s) for m, s in ((0, 0), (30, 0), (0, 5), (30, 5))]
    rows = [("A", 1, at[0], "f", 100), ("A", 2, at[1], "f", 150), ("B", 3, at[2], "f", 100), ("B", 4, at[3], "f", 170), ("C", 5, at[0], "f", 1)]
    df = spark.createDataFrame(rows, "server string, snap int, ts timestamp_ntz, f string, n long")
    out = counter_delta(df, "snap", "ts", ["f"], ["n"], by=["server"]).collect()
    assert sorted((r.server, r.n, r.duration_sec) for r in out) == [("A", 50, 1800), ("B", 70, 1800)]


def test_group_max_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2)], "k string, v long")
    assert sorted((tuple(r) for r in with_group_max(df, ["k"], "v", "m").collect()), key=repr) == sorted([(None, 1, 3), (None, 3, 3), ("a", 2, 2)], key=repr)


def test_pattern_scan_reports_every_hit(spark):
    df = spark.createDataFrame([(i, "g", "Exec(x)") for i in range(5)], "id int, g string, t string")
    assert FL.pattern_scan(df, "t", ["EXEC("]).count() == 5


def test_rows_are_dealt_by_key_before_they_are_listed(spark):
    """Lists begin where all rows of a key are: no list is sent, only rows."""
    from watchloom.operators.aggregates import concat_rows

    df = spark.range(1000).selectExpr("id % 300 k", "id o", "concat('v', id) v")
    out = concat_rows(df, ["k"], "v", ",", ["o"], "vs")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_collect_list") < plan.index("Exchange")
    assert {r["k"]: r["vs"] for r in out.collect()} == {k: ",".join(f"v{i}" for i in range(k, 1000, 300)) for k in range(300)}
