import pytest
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators import graph as G


def edges(spark, pairs, a="src", b="dst"):
    return spark.createDataFrame(pairs, f"{a} long, {b} long")


def test_blocking_chain_example(spark, rows):
    e = edges(spark, [(51, 52), (52, 53), (53, 0)], "session_id", "blocking_session_id")
    chain = G.chain_up(e, spark.createDataFrame([(51,)], "s long"))
    assert rows(chain.select("session_id", "blocking_session_id"), "session_id") == [(51, 52), (52, 53)]


def test_start_without_blocker_comes_out(spark, rows):
    e = edges(spark, [(5, 0)], "session_id", "blocking_session_id")
    assert rows(G.chain_up(e, e.select("session_id"))) == [(5, 0, 5, 0, False)]


def test_chain_cycle_ends_and_is_marked(spark):
    e = edges(spark, [(1, 2), (2, 1)], "session_id", "blocking_session_id")
    out = G.chain_up(e, spark.createDataFrame([(1,)], "s long")).orderBy("level").collect()
    assert [(r.session_id, r.closes_cycle) for r in out] == [(1, False), (2, True)]


def test_levels_and_cycle(spark, rows):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 3), (7, 8), (8, 7), (8, 9)], "master", "slave")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8, 9)], "n long")
    out = {r.node: (r.level, r.in_cycle) for r in G.topo_levels(e, nodes).collect()}
    assert out == {1: (0, False), 2: (1, False), 3: (2, False), 4: (0, False), 7: (None, True), 8: (None, True), 9: (None, True)}


def test_no_edges(spark):
    e = edges(spark, [], "master", "slave")
    assert G.topo_levels(e, spark.createDataFrame([(1,)], "n long")).first().level == 0


def test_builtin_objects_count_as_level_one(spark):
    obj = spark.createDataFrame(
        [(1, "b", "P", True), (2, "u", "P", False), (3, "v", "P", False), (4, "alone", "P", True), (5, "w", "P", False)],
        "object_id long, object_name string, object_type string, is_builtin boolean",
    )
    e = edges(spark, [(2, 1), (5, 3)], "referencing", "referenced")
    out = {r.object_name: r.dependency_level for r in G.dependency_levels(e, obj, ["P"]).collect()}
    assert out == {"b": 1, "u": 2, "v": 0, "w": 1}


def test_forest_orders_by_number(spark):
    rep = [("L", 9, 0, 1, 0), ("L", 10, 0, 1, 0), ("L", 11, 2, 9, 0)]
    df = spark.createDataFrame(rep, "monitorloop string, blocked_spid int, blocked_ecid int, blocking_spid int, blocking_ecid int")
    out = G.blocking_forest(df.withColumn("end_time", ntz("2024-01-01 10:00:00"))).collect()
    assert [(r.spid, r.level, r.chain, r.blocking_tree, r.trace_time) for r in out] == [
        (1, 0, "/1.0/", "1", "Lead"),
        (9, 1, "/1.0/9.0/", "    9", "2024-01-01 10:00:00"),
        (11, 2, "/1.0/9.0/11.2/", "        11(2)", "2024-01-01 10:00:00"),
        (10, 1, "/1.0/10.0/", "    10", "2024-01-01 10:00:00"),
    ]


def test_chain_of_replacements(spark):
    n = 300
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.when(F.col("id") > 1, F.col("id") - 1).alias("ref"), F.lit("SUCCEED").alias("status"))
    out = {r.r: (r.replaced_by, r.status) for r in G.collapse_chain(df, "r", "ref").collect()}
    assert out[n] == (None, "SUCCEED") and all(out[i] == (n, "CANCELED") for i in range(1, n))


def test_branching_replacements_leave_one(spark):
    log = [(1, None), (2, 1), (3, 1), (5, 2), (6, 2), (9, 77), (10, 9), (11, 11)]
    df = spark.createDataFrame([(*r, "SUCCEED") for r in log], "r long, ref long, status string")
    out = sorted((r.r, r.replaced_by) for r in G.collapse_chain(df, "r", "ref").collect())
    assert out == [(1, 6), (2, 6), (3, 6), (5, 6), (6, None), (9, 10), (10, None), (11, None)]


def test_tree_paths_mark_what_has_no_root(spark, rows):
    nodes = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (8, 9, "x"), (9, 8, "y"), (10, 9, "z"), (20, 99, "d"), (21, 20, "e")]
    out = rows(G.tree_paths(spark.createDataFrame(nodes, "id long, parent long, name string"), "id", "parent", "name", "\\"), "id")
    assert out[:3] == [(1, "a\\", 1, "rooted"), (2, "a\\b\\", 2, "rooted"), (3, "a\\b\\c\\", 3, "rooted")]
    assert out[3:6] == [(k, None, None, "cycle") for k in (8, 9, 10)]
    assert out[6:] == [(20, "d\\", 1, "dangling"), (21, "d\\e\\", 2, "dangling")]


def test_both_blockers_of_a_session_come_out(spark, rows):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 0)], "session_id", "blocking_session_id")
    out = G.chain_up(e, spark.createDataFrame([(1,)], "s long"))
    assert rows(out.select("level", "session_id", "blocking_session_id"), "session_id", "blocking_session_id") == [(0, 1, 2), (0, 1, 3), (1, 2, 4), (1, 3, 4)]


def test_long_chains_are_followed_to_the_end(spark):
    e = edges(spark, [(i, i + 1) for i in range(40)], "src", "dst")
    out = G.reach(spark.createDataFrame([(0,)], "node long"), e)
    assert out.agg(F.count("*"), F.max("level")).first()[:] == (41, 40)


def test_reach_survives_cycles_and_hubs(spark):
    hub = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 200)]
    out = G.reach(spark.createDataFrame([(0,)], "node long"), edges(spark, hub).distinct())
    assert out.count() == 400 and out.agg(F.max("level")).first()[0] == 1


def test_result_does_not_depend_on_partitions(spark):
    e = edges(spark, [(i // 3, i) for i in range(1, 200)], "master", "slave")
    nodes = spark.range(200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(tuple(r) for r in G.topo_levels(e, nodes).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_clear_plan_order(spark):
    e = edges(spark, [(1, 2), (2, 3), (5, 6)], "master", "slave")
    plan = G.clear_plan(e, spark.createDataFrame([(1,)], "n long")).collect()
    assert [(r.step, r.object) for r in plan] == [(1, 2), (1, 3), (2, 3), (2, 2), (2, 1), (3, 2), (3, 3)]


def longest(pairs, nodes):
    """Levels by repeated relaxation, None on or behind cycles."""
    into = {}
    for a, b in set(pairs):
        if a != b:
            into.setdefault(b, set()).add(a)
    level, todo = {}, set(nodes) | {x for p in pairs for x in p}
    while True:
        ready = {n for n in todo if all(p in level for p in into.get(n, ()))}
        if not ready:
            return level | dict.fromkeys(todo)
        for n in ready:
            level[n] = max((level[p] + 1 for p in into.get(n, ())), default=0)
        todo -= ready


PATH = [(i, i + 1) for i in range(5000)]
BRANCHES = [(i, 10_000 + i) for i in range(0, 5000, 7)]
JOINING = [(20_000 + i, i) for i in range(100, 5000, 11)] + [(30_000, 20_000 + 100)] + [(i, i + 3) for i in range(2000, 2030)]
CIRCLE = [(5000, 40_000), (40_000, 40_001), (40_001, 40_000), (40_001, 40_002)]


@pytest.mark.parametrize(("pairs", "most"), [(PATH + BRANCHES, 25), (PATH + BRANCHES + JOINING + CIRCLE, 60)])
def test_deep_graphs_take_few_rounds(spark, monkeypatch, pairs, most):
    """A path of 5,000 nodes with branches that leave it; also with roots that join it, shortcuts and a cycle behind it."""
    rounds, count = [], G.materialize_counted
    monkeypatch.setattr(G, "materialize_counted", lambda *a: rounds.append(1) or count(*a))
    e = edges(spark, pairs, "master", "slave")
    out = {r.node: r.level for r in G.topo_levels(e, e.select("master").distinct()).collect()}
    assert out == longest(pairs, [])
    assert len(rounds) <= most


def test_levels_of_random_graphs(spark, monkeypatch):
    import random

    monkeypatch.setattr(G, "_PEELS", 1)
    for seed in range(3):
        r = random.Random(seed)
        pairs = [(a, a + r.randrange(1, 4)) for a in range(60) for _ in range(r.choice([0, 1, 1, 2]))] + [(r.randrange(60), r.randrange(60)) for _ in range(seed)]
        e = edges(spark, pairs, "master", "slave")
        out = {x.node: x.level for x in G.topo_levels(e, spark.range(64)).collect()}
        assert out == longest(pairs, range(64))
