"""Graph operators over edge tables.

Two iteration schemes carry all of them: ``fixpoint`` (semi-naive frontier expansion) and
pointer doubling for one-parent structures, which needs only log2(depth) rounds. Every
round writes its small result to shared storage, so plans stay one round long, a lost
executor costs one round at most, and the planner knows each frontier's true size: a small
frontier is broadcast against the edge scan, a large one is joined by shuffle with adaptive
skew splitting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize, materialize_counted, read_like


#: Visited rows of so many rounds are written together, so that a round never opens many folders.
_COMPACT = 16


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], label: str = "frontier") -> DataFrame:
    """All rows reachable from ``seed`` by ``step``; a row counts as known by its ``keys``.

    Only the last frontier is joined in each round. Known rows never re-enter, so cycles end
    and the rounds stop by themselves, however deep the graph.
    """
    spark, cols = seed.sparkSession, seed.columns
    frontier, n, path = materialize_counted(seed.dropDuplicates(keys), label)
    schema, known = frontier.schema, [path]
    while n:
        if len(known) > _COMPACT:
            known = [materialize_counted(read_like(spark, known, schema), label)[2]]
        seen = read_like(spark, known, schema).select(*keys)
        fresh = step(frontier).select(*cols).dropDuplicates(keys).join(seen, keys, "left_anti").select(*cols)
        frontier, n, path = materialize_counted(fresh, label)
        if n:
            known.append(path)
    return read_like(spark, known, schema)


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (src, dst) pairs without self references, written once and scanned per round."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    return materialize(pairs, "edges")


def reach(seeds: DataFrame, edges: DataFrame, label: str = "reach") -> DataFrame:
    """(node, level) reachable along (src, dst) edges; seeds have level 0."""

    def step(frontier):
        return frontier.join(edges, frontier["node"] == edges["src"]).select(
            F.col("dst").alias("node"), (F.col("level") + 1).alias("level")
        )

    return fixpoint(seeds.select("node", F.lit(0).alias("level")), step, ["node"], label=label)


def heads(edges: DataFrame, blocked: list[str], blocking: list[str], within: list[str]) -> DataFrame:
    """Blockers that are never blocked, per ``within`` group."""
    names = [f"_h{i}" for i in range(len(blocking))]
    blockers = edges.select(*within, *[F.col(c).alias(n) for c, n in zip(blocking, names)])
    blockeds = edges.select(*within, *[F.col(c).alias(n) for c, n in zip(blocked, names)])
    out = blockers.distinct().join(blockeds.distinct(), [*within, *names], "left_anti")
    return out.select(*within, *[F.col(n).alias(c) for n, c in zip(names, blocking)])


def chain_up(
    edges: DataFrame, starts: DataFrame, id_col: str = "session_id", blocker: str = "blocking_session_id", by: list[str] | None = None
) -> DataFrame:
    """Each start's chain of blockers as (by, start_id, level, session_id, blocking_session_id).

    Session ids are local to a server: with ``by``, whose columns come first in ``starts``, a chain
    stays on its server.

    The start's own row always comes out; a later session with no blocker (0) ends the chain
    without a row of its own. A session with several blockers has a row for each of them. A chain
    that runs into itself stops, and its closing row is marked ``closes_cycle``.
    """
    by = list(by or [])
    e = materialize(edges.select(*by, F.col(id_col).alias("session_id"), F.col(blocker).alias("blocking_session_id")).distinct(), "edges")
    seed = e.join(starts.toDF(*by, "session_id").distinct(), [*by, "session_id"]).select(
        *by, F.col("session_id").alias("start_id"), F.lit(0).alias("level"), "session_id", "blocking_session_id"
    )
    nxt = e.where("blocking_session_id <> 0").toDF(*by, "_s", "_b")

    def step(frontier):
        met = frontier.withColumnRenamed("blocking_session_id", "_s").join(nxt, [*by, "_s"])
        return met.select(*by, "start_id", (F.col("level") + 1).alias("level"), F.col("_s").alias("session_id"), F.col("_b").alias("blocking_session_id"))

    chain = fixpoint(seed, step, [*by, "start_id", "session_id", "blocking_session_id"], label="chain")
    met = chain.groupBy(*by, "start_id", "session_id").agg(F.min("level").alias("_l"))
    back = met.withColumnRenamed("session_id", "blocking_session_id")
    closing = F.coalesce(F.col("_l") <= F.col("level"), F.lit(False))
    marked = chain.join(back, [*by, "start_id", "blocking_session_id"], "left").withColumn("closes_cycle", closing)
    return marked.select(*by, "start_id", "level", "session_id", "blocking_session_id", "closes_cycle")


def blocking_forest(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Blocking trees per monitor loop with path, level, indented label and report time.

    With ``by`` (the server) loops of one name on two servers stay apart. ``reports``: (monitorloop, end_time, blocked_spid, blocked_ecid, blocking_spid,
    blocking_ecid) plus anything else to carry. Sorted by loop and true numeric path.
    """
    spark = reports.sparkSession
    loop = [*(by or []), "monitorloop"]
    ids = [*loop, "blocked_spid", "blocked_ecid", "blocking_spid", "blocking_ecid"]
    e = materialize(reports.select(*ids).distinct(), "edges")

    def node(spid, ecid):
        return F.struct(F.col(spid).alias("spid"), F.col(ecid).alias("ecid"))

    def piece(spid, ecid):
        return F.concat(F.col(spid).cast("string"), F.lit("."), F.col(ecid).cast("string"), F.lit("/"))

    top = heads(e, ids[-4:-2], ids[-2:], loop).select(
        *loop,
        F.col("blocking_spid").alias("spid"),
        F.col("blocking_ecid").alias("ecid"),
        F.lit(0).alias("level"),
        F.array(node("blocking_spid", "blocking_ecid")).alias("path"),
        F.concat(F.lit("/"), piece("blocking_spid", "blocking_ecid")).alias("chain"),
    )
    frontier, n, path = materialize_counted(top, "forest")
    schema, parts = frontier.schema, []
    while n:
        parts.append(path)
        f = frontier.withColumnsRenamed({"spid": "blocking_spid", "ecid": "blocking_ecid"})
        child = node("blocked_spid", "blocked_ecid")
        grown = (
            f.join(e, [*loop, "blocking_spid", "blocking_ecid"])
            .where(~F.array_contains(F.col("path"), child))
            .select(
                *loop,
                F.col("blocked_spid").alias("spid"),
                F.col("blocked_ecid").alias("ecid"),
                (F.col("level") + 1).alias("level"),
                F.array_append("path", child).alias("path"),
                F.concat("chain", piece("blocked_spid", "blocked_ecid")).alias("chain"),
            )
        )
        frontier, n, path = materialize_counted(grown, "forest")
    tree = read_like(spark, parts, schema) if parts else frontier
    detail = reports.drop("blocking_spid", "blocking_ecid").withColumnsRenamed({"blocked_spid": "spid", "blocked_ecid": "ecid"})
    shown = F.concat(
        F.repeat(F.lit(" "), F.col("level") * 4),
        F.col("spid").cast("string"),
        F.when(F.col("ecid") == 0, "").otherwise(F.concat(F.lit("("), F.col("ecid").cast("string"), F.lit(")"))),
    )
    out = tree.join(detail, [*loop, "spid", "ecid"], "left")
    return out.withColumns(
        {"trace_time": F.coalesce(F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"), F.lit("Lead")), "blocking_tree": shown}
    ).orderBy(*loop, "path")


#: Least rounds of peeling between two contractions.
_PEELS = 6


def peel_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, in_cycle): longest distance from the roots, found by peeling and contraction.

    A node is peeled in the round after its last predecessor, so its level is one more than
    the highest of them. What is left after ``_PEELS`` rounds, or once rounds stop growing, is contracted: a node with one predecessor
    left has the level ``max(b, level of that predecessor + w)``, such functions compose, and
    doubling finds for all nodes of a way at once the function of the node it begins at. The nodes of ways are
    set aside until that node has its level, so the rounds follow the branching of a graph and not its
    depth. Nodes on or behind a cycle never get a level: they come out with a null one and ``in_cycle`` true.

    ``edges`` are distinct (src, dst) pairs without self references, ``nodes`` one column.
    """
    spark = nodes.sparkSession
    ids = nodes.toDF("node").unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node")))
    ids = every = materialize(ids.distinct(), "nodes")
    edges = edges.select("src", "dst", F.lit(1).alias("w"))
    base = None
    levels, ways = [], []
    while True:
        found, finished = _peel(ids, edges, base)
        levels.append(found)
        if finished:
            break
        ids, edges, base, way = _contract(ids, edges, base, found)
        ways.append(way)
    known = levels[0]
    for more in levels[1:]:
        known = known.unionByName(more)
    for way in reversed(ways):
        start = known.select(F.col("node").alias("nxt"), "level")
        placed = way.join(start, "nxt").select(F.col("id").alias("node"), F.greatest("f.b", F.col("level") + F.col("f.w")).alias("level"))
        known = materialize(known.unionByName(placed), "levels")
    return every.join(known, "node", "left").withColumn("in_cycle", F.col("level").isNull())


def _peel(ids: DataFrame, edges: DataFrame, base: DataFrame | None) -> tuple[DataFrame, bool]:
    """(node, level) peeled in ``_PEELS`` rounds or while they grow, and whether that was all there is to peel.

    ``edges`` (src, dst, w); ``base`` (node, level): what predecessors that are gone have left.
    """
    spark = ids.sparkSession
    zero = F.lit(0).cast("long")
    indegree = materialize(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("need")), "indegree")
    if base is None:
        first = ids.join(indegree, "node", "left_anti").select("node", zero.alias("got"), zero.alias("need"), F.lit(0).alias("level"))
    else:
        # Nodes wait with what they have from before; those without any edge left are next.
        met = ids.join(base, "node", "left").join(indegree, "node", "left").where("need IS NULL OR level IS NOT NULL")
        first = met.select("node", zero.alias("got"), F.coalesce("need", zero).alias("need"), F.coalesce("level", F.lit(0)).alias("level"))
    complete = "got = need"
    state, n, path = materialize_counted(first, "level", complete)
    schema, parts = state.schema, [path]
    before = rounds = 0
    # As long as each round peels twice as many as the last, the rest can't be deep.
    while n and (rounds < _PEELS or n >= 2 * before):
        before, rounds = n, rounds + 1
        out = state.where(complete).join(edges, F.col("node") == edges["src"])
        got = out.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("got"), F.max(F.col("level") + F.col("w")).alias("level"))
        # Nodes met but not complete wait with one row each; a round touches those and its own hits.
        fresh = _add(state.where("got < need"), got, indegree)
        state, n, path = materialize_counted(fresh, "level", complete)
        parts.append(path)
    return read_like(spark, parts, schema).where(complete).select("node", "level"), not n


def _add(waiting: DataFrame, got: DataFrame, indegree: DataFrame) -> DataFrame:
    """``waiting`` with the hits of this round added; new nodes get their ``need``."""
    old = waiting.select("node", F.col("got").alias("before"), "need", F.col("level").alias("high"))
    count = (F.col("before") + F.coalesce("got", F.lit(0))).alias("got")
    known = old.join(got, "node", "left").select("node", count, "need", F.greatest("high", "level").alias("level"))
    new = got.join(old.select("node"), "node", "left_anti").join(indegree, "node")
    return known.unionByName(new.select("node", "got", "need", "level"))


def _contract(ids: DataFrame, edges: DataFrame, base: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left without the ``found`` nodes and without ways: nodes, edges, base, and the ways.

    A way's rows are (id, nxt, f): the level of ``id`` is ``max(f.b, level of nxt + f.w)``.
    """
    ids = materialize(ids.join(found, "node", "left_anti"), "left")
    open_edges = edges.join(ids.select(F.col("node").alias("dst")), "dst", "left_semi")
    leveled = open_edges.join(found.select(F.col("node").alias("src"), F.col("level").alias("at")), "src", "left")
    leveled = materialize(leveled.select("src", "dst", "w", "at"), "edges")
    gone = leveled.where("at IS NOT NULL").select(F.col("dst").alias("node"), (F.col("at") + F.col("w")).alias("level"))
    if base is not None:
        gone = gone.unionByName(base.join(ids, "node", "left_semi").select("node", "level"))
    base = materialize(gone.groupBy("node").agg(F.max("level").alias("level")), "base")
    edges = leveled.where("at IS NULL").select("src", "dst", "w")
    single = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("src").alias("nxt"), F.max("w").alias("w")).where("n = 1")
    links = single.join(base.withColumnRenamed("node", "id"), "id", "left").select("id", "nxt", F.struct(F.col("level").alias("b"), "w").alias("f"))

    def follow(mine: Column, above: Column) -> Column:
        return F.struct(F.greatest(mine["b"], above["b"] + mine["w"]).alias("b"), (mine["w"] + above["w"]).alias("w"))

    # Ways that run in a circle have no beginning: they stay in the graph and are never peeled.
    way = materialize(_double(links, {"f": follow}, "way").where("NOT in_cycle").select("id", "nxt", "f"), "ways")
    off = way.select(F.col("id").alias("src"), F.col("nxt").alias("begin"), "f")
    rest = edges.join(way.select(F.col("id").alias("dst")), "dst", "left_anti").join(off, "src", "left")
    rest = materialize(rest.select(F.coalesce("begin", "src").alias("src"), "dst", (F.col("w") + F.coalesce("f.w", F.lit(0))).alias("w"), (F.col("f.b") + F.col("w")).alias("b")), "rest")
    ids = ids.join(way.select(F.col("id").alias("node")), "node", "left_anti")
    left = base.join(way.select(F.col("id").alias("node")), "node", "left_anti").unionByName(rest.where("b IS NOT NULL").select(F.col("dst").alias("node"), F.col("b").alias("level")))
    edges = rest.groupBy("src", "dst").agg(F.max("w").alias("w"))
    return materialize(ids, "left"), materialize(edges, "edges"), materialize(left.groupBy("node").agg(F.max("level").alias("level")), "base"), way


def topo_levels(edges: DataFrame, nodes: DataFrame, master: str = "master", slave: str = "slave", by: list[str] | None = None) -> DataFrame:
    """Load order of tables: 0 for tables without foreign keys, else one more than the highest master.

    ``nodes`` has the ``by`` columns (server, database) first, if any, then the node.
    """
    if not by:
        return peel_levels(nodes, _edges(edges, master, slave)).orderBy("level", "node")
    ids = nodes.toDF(*by, "node").select(F.struct(*by, "node").alias("node"))
    ends = [F.struct(*by, F.col(c).alias("node")).alias(c) for c in (master, slave)]
    levels = peel_levels(ids, _edges(edges.select(*ends), master, slave))
    return levels.select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.node").alias("node"), "level", "in_cycle").orderBy("level", *by, "node")


def dependency_levels(
    edges: DataFrame, objects: DataFrame, types: list[str], referencing: str = "referencing", referenced: str = "referenced"
) -> DataFrame:
    """Dependency level of objects of the wanted types.

    ``objects``: (object_id, object_name, object_type, is_builtin). Objects that reference
    nothing are level 0, or 1 when they are built in; a referencing object is one above its
    highest reference. Built-in objects only appear when referenced.
    """
    wanted = objects.where(F.col("object_type").isin(list(types)))
    ids = wanted.select(F.col("object_id").alias("_id"))
    e = edges.join(ids, F.col(referencing) == F.col("_id"), "left_semi").join(ids, F.col(referenced) == F.col("_id"), "left_semi")
    # a built-in base counts as one level by hanging below a common virtual node
    e = _edges(e, referenced, referencing)
    builtin = wanted.where("is_builtin").select(F.col("object_id").alias("dst"))
    base = builtin.join(e.select(F.col("src").alias("dst")), "dst", "left_semi").join(e.select("dst"), "dst", "left_anti")
    virtual = base.select(F.lit(None).cast(e.schema["src"].dataType).alias("src"), "dst")
    own = wanted.where("NOT is_builtin").select(F.col("object_id").alias("node"))
    levels = _peel_with_base(own, e, virtual)
    return levels.join(wanted, levels["node"] == wanted["object_id"]).select(
        "object_id", "object_name", "object_type", F.col("level").alias("dependency_level"), "in_cycle"
    )


def _peel_with_base(nodes: DataFrame, edges: DataFrame, virtual: DataFrame) -> DataFrame:
    """Levels where the ``virtual`` destinations start one higher than other roots."""
    sentinel = F.lit(-(2**62))
    dtype = edges.schema["src"].dataType
    extra = virtual.select(sentinel.cast(dtype).alias("src"), "dst")
    all_edges = materialize(edges.unionByName(extra), "edges")
    return peel_levels(nodes, all_edges).where(F.col("node") != sentinel.cast(dtype))


def closure_pairs(edges: DataFrame, roots: DataFrame, include_roots: bool = False) -> DataFrame:
    """(root, node, level): everything each root reaches along (src, dst) edges."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    seed = roots.toDF("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("level"))

    def step(frontier):
        return frontier.join(e, frontier["node"] == e["src"]).select("root", F.col("dst").alias("node"), (F.col("level") + 1).alias("level"))

    pairs = fixpoint(seed, step, ["root", "node"], label="closure")
    return pairs if include_roots else pairs.where("level > 0")


def dependency_closure(items: DataFrame, roots: DataFrame, include_roots: bool = True) -> DataFrame:
    """(root, node): each root item with all items it needs, directly or not, once each.

    The pairs are listed from labels (``reachability``), so rounds don't follow the depth and no
    round holds pairs; ``item_needs`` gives the labels to ask without listing any. For distances see ``closure_pairs``.
    """
    from watchloom.operators.reachability import reached_pairs

    return reached_pairs(item_needs(items), roots, include_roots)


def item_needs(items: DataFrame):
    """Reachability labels of items: an item reaches what it needs.

    ``items``: (item_id, item_name, item_version, publisher_name, update_date, depends_on
    array<struct<name, version>>). Every dependency is resolved to the best item of the same
    publisher once, before the iteration.
    """
    from watchloom.operators.joins import resolve_items
    from watchloom.operators.reachability import reach_labels

    wants = items.select("item_id", "publisher_name", F.explode("depends_on").alias("d"))
    distinct_wants = wants.select("publisher_name", F.col("d.name").alias("item_name"), F.col("d.version").alias("item_version")).distinct()
    key = F.xxhash64("publisher_name", "item_name", "item_version")
    best = resolve_items(distinct_wants.withColumn("request_id", key), items.drop("depends_on"))
    wants = wants.withColumn("request_id", F.xxhash64("publisher_name", "d.name", "d.version"))
    edges = wants.select("request_id", F.col("item_id").alias("src")).join(
        best.select("request_id", F.col("item_id").alias("dst")), "request_id"
    )
    return reach_labels(edges.select("src", "dst"), items.select("item_id"))


def _double(links: DataFrame, merge: dict[str, Callable[[Column, Column], Column]], label: str) -> DataFrame:
    """Pointer doubling over (id, nxt, ...): each row ends at the last pointer of its way.

    ``nxt`` of the result is null below a row that points nowhere, or the id that no row has.
    ``merge`` combines a carried column of the row with that of the row it points to. Finished
    rows are set aside, so a round only moves those still on their way. A row far from its end has others
    at every shorter distance above it, so a round in which no row ends leaves only those on or below a
    cycle: they come out with ``in_cycle`` true and their carried columns null. Ids are unique.
    """
    spark, carried = links.sparkSession, list(merge)
    rows = links.select("id", "nxt", *carried, F.col("nxt").isNull().alias("_end"))
    step, n, path = materialize_counted(rows, label, "NOT _end")
    schema, steps = step.schema, [path]
    while n:
        # rows finished in any round, and those of the last one that are still moving
        done, moving = read_like(spark, steps, schema).where("_end"), step.where("NOT _end")
        at = done.unionByName(moving)
        joined = moving.alias("a").join(at.alias("b"), F.col("a.nxt") == F.col("b.id"), "left")
        met = F.col("b.id").isNotNull()
        jumped = joined.select(
            F.col("a.id").alias("id"),
            F.when(met, F.col("b.nxt")).otherwise(F.col("a.nxt")).alias("nxt"),
            *[F.when(met, merge[c](F.col(f"a.{c}"), F.col(f"b.{c}"))).otherwise(F.col(f"a.{c}")).alias(c) for c in carried],
            F.coalesce("b._end", F.lit(True)).alias("_end"),
        )
        step, left, path = materialize_counted(jumped, label, "NOT _end")
        steps.append(path)
        if left == n:
            break
        n = left
    final = read_like(spark, steps, schema).where("_end").drop("_end").withColumn("in_cycle", F.lit(False))
    lost = [F.lit(None).cast(schema[c].dataType).alias(c) for c in ("nxt", *carried)]
    return final.unionByName(step.where("NOT _end").select("id", *lost, F.lit(True).alias("in_cycle")))


def collapse_chain(df: DataFrame, id_col: str, ref_col: str, status: str = "status", usable: Column | None = None) -> DataFrame:
    """Replacement chains: of all records that replace one another only the newest stays.

    A usable record replaces the older record it refers to. Records tied together that way form
    a tree; its deepest record, of several the one with the largest id, stays, and every other
    one is CANCELED with that record in ``replaced_by``. One row per record comes out.
    """
    ids = df.select(F.col(id_col).alias("ref"))
    valid = df.where(usable) if usable is not None else df
    up = valid.where(F.col(id_col) > F.col(ref_col)).select(F.col(id_col).alias("id"), F.col(ref_col).alias("ref"))
    up = up.join(ids, "ref", "left_semi").select("id", F.col("ref").alias("nxt"))
    links = df.select(F.col(id_col).alias("id")).join(up, "id", "left")
    links = links.withColumns({"top": F.coalesce("nxt", "id"), "depth": F.col("nxt").isNotNull().cast("int")})
    merge = {"top": lambda mine, above: above, "depth": lambda mine, above: mine + above}
    placed = materialize(_double(links, merge, "replace").select("id", "top", "depth"), "trees")
    last = placed.groupBy("top").agg(F.max(F.struct("depth", "id"))["id"].alias("replaced_by"))
    beaten = placed.join(last, "top").where("id <> replaced_by").select(F.col("id").alias(id_col), "replaced_by")
    out = df.join(beaten, id_col, "left")
    return out.withColumn(status, F.when(F.col("replaced_by").isNotNull(), "CANCELED").otherwise(F.col(status)))


def tree_paths(df: DataFrame, id_col: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """(id, path, depth, placed): each node's full path from its root, root depth 1.

    ``placed`` is ``rooted``; ``dangling`` for nodes under a parent that isn't there, whose path
    begins at the topmost node present; ``cycle``, without path and depth, for nodes on or below a cycle.
    """
    links = df.select(
        F.col(id_col).alias("id"),
        F.col(parent).alias("nxt"),
        F.concat(F.col(name), F.lit(separator)).alias("path"),
        F.lit(1).alias("depth"),
    )
    merge = {"path": lambda mine, above: F.concat(above, mine), "depth": lambda mine, above: mine + above}
    placed = F.when(F.col("in_cycle"), "cycle").when(F.col("nxt").isNull(), "rooted").otherwise("dangling")
    return _double(links, merge, "tree").select(F.col("id").alias(id_col), "path", "depth", placed.alias("placed"))


def reachable_to(edges: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Principals that reach a target along edges, targets included."""
    back = materialize(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst")).distinct(), "edges")
    return reach(targets.toDF("node"), back, "escalation").select("node")


def affected_by(edges: DataFrame, root: DataFrame, master: str = "master", slave: str = "slave") -> DataFrame:
    """(node, level): the tables hanging on ``root`` through foreign keys, root included."""
    return reach(root.toDF("node"), _edges(edges, master, slave), "affected")


def clear_plan(edges: DataFrame, root: DataFrame, master: str = "master", slave: str = "slave") -> DataFrame:
    """Ordered plan to empty ``root`` and everything hanging on it.

    Step 1 detaches each foreign key between affected tables, step 2 clears the tables from
    the deepest up, step 3 attaches the keys again.
    """
    e = _edges(edges, master, slave)
    nodes = reach(root.toDF("node"), e, "affected")
    keys = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")

    def key_rows(step, action):
        return keys.select(
            F.lit(step).alias("step"),
            F.lit(action).alias("action"),
            F.col("dst").alias("object"),
            F.col("src").alias("parent"),
            F.lit(0).alias("level"),
        )

    tables = nodes.select(
        F.lit(2).alias("step"), F.lit("CLEAR").alias("action"), F.col("node").alias("object"), F.lit(None).alias("parent"), "level"
    )
    plan = key_rows(1, "DETACH").unionByName(tables.withColumn("parent", F.col("parent").cast(e.schema["src"].dataType)))
    return plan.unionByName(key_rows(3, "ATTACH")).orderBy("step", F.col("level").desc(), "object", "parent")
