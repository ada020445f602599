"""Who reaches whom in a graph, kept as spans of tree places instead of pairs.

Every node follows one of its edges, which makes a forest once circles are contracted; a tree's nodes get
consecutive places, so all nodes below one are a span. Only edges off the forest add spans. Whether
one node reaches another is then one equi-join, and pairs are listed on demand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.graph import _double, fixpoint
from watchloom.session import materialize, materialize_counted


@dataclass(frozen=True)
class Reach:
    """``members`` (node, class, place), ``spans`` (class, low, high), and the bits that a place takes.

    Nodes of one class reach each other. A node reaches another if its place lies in a span of the other's class;
    the spans of a class don't overlap.
    """

    members: DataFrame
    spans: DataFrame
    bits: int


def reach_labels(edges: DataFrame, nodes: DataFrame | None = None) -> Reach:
    """Labels for the (src, dst) ``edges``: a node reaches itself and all that lies behind its edges.

    Null ends, self references and repeated edges add nothing; ``nodes`` (one column) may name nodes without edges. Ids have any
    one orderable type. Rounds follow the logarithm of the forest's depth; edges off the forest add rounds as far as
    their finds climb. Circles of followed edges are contracted until none is left. Cycles that only edges off the forest
    close stay several classes that hold spans of each other: the result is the same, only larger.
    """
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    ids = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        ids = ids.unionByName(nodes.toDF("node").where("node IS NOT NULL"))
    member, edges, followed = _condense(ids.distinct(), edges)
    forest = followed.select("id", F.when(F.col("id") != F.col("nxt"), F.col("nxt")).alias("parent"))
    placed = forest_places(forest)
    own, n, _ = materialize_counted(placed.select(F.col("id").alias("class"), F.col("place").alias("low"), (F.col("place") + F.col("size") - 1).alias("high")), "places")
    members = materialize(member.join(own.select("class", F.col("low").alias("place")), "class").select("node", "class", "place"), "members")
    return Reach(members, _spans(edges, followed, own), max(n - 1, 1).bit_length())


def reaches(labels: Reach, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (root, node) whose root reaches the node; unknown ids reach nothing."""
    member = labels.members
    by_place = asked.join(member.select(F.col("node").alias("root"), "place"), "root").join(member.select("node", "class"), "node")
    ways = by_place.select("root", "node", "class", _above(F.col("place"), labels.bits))
    return ways.join(_blocks(labels), ["class", "bit", "block"], "left_semi").select("root", "node")


def reached_pairs(labels: Reach, roots: DataFrame, include_roots: bool = False) -> DataFrame:
    """(root, node) for every root (one column) and all that it reaches, once each; itself only if asked for.

    A span is cut into blocks whose length is a power of two, at most two of a length, and a place lies in
    one block of each length: an equi-join finds each pair exactly once, whatever the spans' lengths.
    """
    member = labels.members
    root = member.join(roots.toDF("node").distinct(), "node").select(F.col("node").alias("root"), "class", "place")
    # Classes are paired, not nodes: the roots of a class share their place.
    ways = root.select("place").distinct().select("place", _above(F.col("place"), labels.bits))
    classes = ways.join(_blocks(labels), ["bit", "block"]).select("place", "class")
    pairs = classes.join(root.select("root", "place"), "place").join(member.select("node", "class"), "class")
    pairs = pairs.select("root", "node")
    return pairs if include_roots else pairs.where("root <> node")


def _above(place: Column, bits: int) -> Column:
    """Explodes to (bit, block): the blocks of all lengths that a place lies in."""
    return F.inline(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(k.alias("bit"), _shift(place, k).alias("block"))))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _blocks(labels: Reach) -> DataFrame:
    """(class, bit, block): the fewest blocks that a span is made of."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, end = _shift(F.col("low") + size - 1, k), _shift(F.col("high") + 1, k)
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias("bit"), first.alias("block")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(k.alias("bit"), (end - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(labels.bits)), at))
    return labels.spans.select("class", F.inline(cut))


def forest_places(forest: DataFrame) -> DataFrame:
    """(id, place, size): 0-based place of each node in pre-order and the number of nodes from it down.

    ``forest``: (id, parent), null for roots; ids are unique, every parent is one of them, siblings stand in the order of
    their ids. What hangs below a node is ``place`` to ``place + size - 1``. Sizes and places are found
    by doubling, in rounds of the logarithm of the depth; siblings are summed over ranges, so no task follows a parent.
    """
    state, moving, _ = materialize_counted(forest.select("id", F.col("parent").alias("nxt"), F.lit(1).cast("long").alias("size")), "sizes", "nxt IS NOT NULL")
    while moving:
        # `size` counts the nodes below at a distance under 2 ** round; those it jumps over come next.
        below = state.where("nxt IS NOT NULL").groupBy(F.col("nxt").alias("id")).agg(F.sum("size").alias("more"))
        above = state.where("nxt IS NOT NULL").select(F.col("id").alias("nxt"), F.col("nxt").alias("next"))
        grown = state.join(below, "id", "left").join(above, "nxt", "left")
        grown = grown.select("id", F.col("next").alias("nxt"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        state, moving, _ = materialize_counted(grown, "sizes", "nxt IS NOT NULL")
    sized = forest.join(state.select("id", "size"), "id")
    before = F.coalesce("_earlier", F.lit(0)) + F.col("parent").isNotNull().cast("long")
    steps = running(sized, ["parent"], ["id"], F.sum, "size", "_earlier").select("id", F.col("parent").alias("nxt"), "size", before.alias("place"))
    steps = materialize(steps, "steps")
    places = _double(steps.select("id", "nxt", "place"), {"place": lambda mine, above: mine + above}, "places")
    return places.select("id", "place").join(steps.select("id", "size"), "id")


def running(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[str], Column], value: str, out: str) -> DataFrame:
    """``fold`` (sum, max, min) of ``value`` over the earlier rows of the key; null for the first.

    Rows are dealt by ranges of (keys, order), which must be unique: a key may span many partitions, and one row
    per partition carries what came before.
    """
    dealt = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    ends = dealt.groupBy("_part", *keys).agg(fold(value).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the key that a partition begins with can continue: one row per partition at most.
    carried = ends.withColumn("_carried", fold("_end").over(earlier)).where("_carried IS NOT NULL").select("_part", *keys, "_carried")
    inside = fold(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    a, b = dealt.withColumn("_inside", inside).alias("a"), F.broadcast(carried.alias("b"))
    same = F.lit(True)
    for c in ["_part", *keys]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = F.array_compact(F.array(F.col("a._inside"), F.col("b._carried")))
    folded = {F.sum: lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda x, y: x + y), F.max: F.array_max, F.min: F.array_min}[fold](both)
    return a.join(b, same, "left").select(*[F.col(f"a.{c}") for c in df.columns], F.when(F.size(both) > 0, folded).alias(out))


def _condense(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, class), the edges between classes, and the edge that each class follows (id, nxt; itself without one)."""
    member = materialize(ids.select("node", F.col("node").alias("class")), "classes")
    drawn = _draw(edges, 0)
    followed = materialize(member.select(F.col("class").alias("id")).join(drawn, "id", "left").select("id", F.coalesce("nxt", "id").alias("nxt")), "followed")
    turn = 0
    while True:
        circle = _circles(followed)
        if circle is None:
            return member, edges, followed
        turn += 1
        into = circle.select(F.col("id").alias("class"), F.col("low").alias("into"))

        def classed(df, *ends):
            for end in ends:
                df = df.join(into.withColumnRenamed("class", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
            return df

        member = materialize(classed(member, "class").select("node", "class"), "classes")
        edges = materialize(classed(edges, "src", "dst").where("src <> dst").distinct().select("src", "dst"), "edges")
        # Only what was a circle has to follow another edge now; the others keep theirs.
        merged = into.select(F.col("into").alias("id")).distinct()
        again = merged.join(_draw(edges.join(merged.withColumnRenamed("id", "src"), "src", "left_semi"), turn), "id", "left")
        again, open_ends, _ = materialize_counted(again.select("id", "nxt"), "drawn", "nxt IS NOT NULL")
        kept = classed(followed.join(circle, "id", "left_anti"), "nxt").select("id", "nxt")
        followed = materialize(kept.unionByName(again.select("id", F.coalesce("nxt", "id").alias("nxt"))), "followed")
        if not open_ends:
            return member, edges, followed


def _draw(edges: DataFrame, turn: int) -> DataFrame:
    """(id, nxt): one edge of each node that has any, drawn anew in each turn: neighbours who point at each other meet in any order of ids."""
    first = F.min(F.struct(F.xxhash64("src", "dst", F.lit(turn)), "dst"))["dst"]
    return edges.groupBy(F.col("src").alias("id")).agg(first.alias("nxt"))


def _follow(state: DataFrame) -> DataFrame:
    """(id, nxt, low) after four times as many steps, ``low`` the least of all ids on the way."""
    out = state
    for _ in range(3):
        met = out.join(state.toDF("_at", "_to", "_low"), F.col("nxt") == F.col("_at"))
        out = met.select("id", F.col("_to").alias("nxt"), F.least("low", "_low").alias("low"))
    return out


def _circles(followed: DataFrame) -> DataFrame | None:
    """(id, low) of the nodes on circles of followed edges, ``low`` the least id of the circle; None without any.

    Only nodes where some way of the length so far ends are kept: they become fewer until circles and
    ends of trees are left. A circle longer than its ways goes on until no ``low`` falls any more.
    """
    state, left, ends = followed.select("id", "nxt", F.least("id", "nxt").alias("low")), None, None
    while left is None or left != ends:
        ends, far = left, _follow(state)
        arrived = far.select(F.col("nxt").alias("id")).distinct()
        state, left, _ = materialize_counted(far.join(arrived, "id", "left_semi"), "ways")
    # Ends of trees follow themselves; a circle's node does so after some number of steps only.
    ring = state.join(followed.where("id <> nxt").select("id"), "id", "left_semi")
    ring, changed, _ = materialize_counted(ring, "circles")
    if not changed:
        return None
    while changed:
        before = ring.select("id", F.col("low").alias("_before"))
        lower = _follow(ring.select("id", "nxt", "low")).join(before, "id").withColumn("changed", F.col("low") != F.col("_before")).drop("_before")
        ring, changed, _ = materialize_counted(lower, "circles", "changed")
    return ring.select("id", "low")


def _spans(edges: DataFrame, followed: DataFrame, own: DataFrame) -> DataFrame:
    """(class, low, high): the forest's span of each class and those that other edges bring, the widest ones only."""
    off = edges.join(followed.select(F.col("id").alias("src"), F.col("nxt").alias("dst")), ["src", "dst"], "left_anti")
    above = own.select(F.col("class").alias("dst"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    news = F.expr("NOT low BETWEEN own_low AND own_high")
    from_src = own.withColumnRenamed("class", "src")
    seed, n, _ = materialize_counted(off.join(from_src, "src").join(above, "dst").where(news).select(F.col("dst").alias("class"), "low", "high"), "links")
    if not n:
        return own
    ways = materialize(edges.join(above, "dst"), "ways-up")

    def step(frontier):
        met = frontier.join(ways, frontier["class"] == ways["src"]).where(news)
        return met.select(F.col("dst").alias("class"), "low", "high")

    found = fixpoint(seed, step, ["class", "low"], "spans")
    # Spans lie inside each other or apart, so one that begins later and ends no later is held by an earlier one.
    spans = own.unionByName(found).withColumn("_wide", -F.col("high"))
    reached = running(spans, ["class"], ["low", "_wide"], F.max, "high", "_reached")
    return materialize(reached.where("_reached IS NULL OR high > _reached").select("class", "low", "high"), "spans")
