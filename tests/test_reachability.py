"""Reachability labels against plain search."""

import random

from pyspark.sql import functions as F

from watchloom.operators import reachability as R


def searched(pairs, nodes):
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, set()).add(b)
    out = set()
    for r in nodes:
        seen, todo = {r}, [r]
        while todo:
            for b in nxt.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(r, n) for n in seen}
    return out


def table(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def check(spark, pairs, alone=(), kind="long"):
    nodes = sorted({n for p in pairs for n in p if n is not None} | set(alone))
    ids = spark.createDataFrame([(n,) for n in nodes], f"n {kind}")
    labels = R.reach_labels(table(spark, pairs, kind), ids)
    want = searched([p for p in pairs if None not in p], nodes)
    got = [tuple(r) for r in R.reached_pairs(labels, ids, include_roots=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    return labels, nodes, want


def test_random_graphs_with_cycles(spark):
    rnd = random.Random(7)
    for n, m in ((25, 35), (12, 40)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        pairs += [*pairs[:5], (None, 3), (3, None), (4, 4)]
        labels, nodes, want = check(spark, pairs, alone=(99,))
        some = spark.createDataFrame([(a, b) for a in (*nodes, 1000) for b in nodes], "root long, node long")
        assert {tuple(r) for r in R.reaches(labels, some).collect()} == want


def test_followed_edges_only(spark):
    """One edge a node, with circles: every class has one span."""
    rnd = random.Random(2)
    labels, _, _ = check(spark, [(i, rnd.randrange(60)) for i in range(60)])
    assert labels.spans.count() == labels.spans.select("class").distinct().count()


def test_neighbours_that_need_each_other_are_one_class(spark):
    ring = [(i, (i + 1) % 50) for i in range(50)]
    assert check(spark, ring)[0].spans.count() == 1
    path = [(i, i + 1) for i in range(8)] + [(i + 1, i) for i in range(8)]
    assert check(spark, path)[0].members.select("class").distinct().count() == 1


def test_diamonds_text_ids_and_some_roots(spark):
    pairs = [(f"n{i}", f"n{j}") for k in range(0, 18, 3) for i, j in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))]
    labels, _, want = check(spark, pairs, kind="string")
    roots = spark.createDataFrame([("n4",), ("n4",), ("absent",)], "n string")
    assert {tuple(r) for r in R.reached_pairs(labels, roots).collect()} == {p for p in want if p[0] == "n4" != p[1]}


def test_empty_and_edgeless(spark):
    none = table(spark, [])
    assert R.reach_labels(none).members.count() == 0
    ids = spark.createDataFrame([(5,), (6,), (None,)], "n long")
    assert sorted(tuple(r) for r in R.reached_pairs(R.reach_labels(none, ids), ids, include_roots=True).collect()) == [(5, 5), (6, 6)]


def test_places_are_pre_order(spark):
    """A deep way, a wide parent and several trees."""
    parent = {0: None, 500: None} | {i: i - 1 for i in range(1, 100)} | {i: 500 for i in range(501, 900)} | {1000: 700}
    df = spark.createDataFrame(sorted(parent.items()), "id long, parent long")
    got = {r.id: (r.place, r["size"]) for r in R.forest_places(df).collect()}
    children, want = {}, {}
    for i, p in sorted(parent.items()):
        children.setdefault(p, []).append(i)

    def walk(node, place):
        end = place + 1
        for c in children.get(node, ()):
            end = walk(c, end)
        want[node] = (place, end - place)
        return end

    at = 0
    for root in children[None]:
        at = walk(root, at)
    assert got == want


def test_running_over_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in R.running(df.repartition(5), ["k"], ["id"], F.sum, "v", "s").collect()}
    total, seen = 0, False
    for i in range(2000):
        if i % 50 == 0:
            assert got[i] is None
        else:
            assert got[i] == (total if seen else None)
            total, seen = total + i % 7, True
