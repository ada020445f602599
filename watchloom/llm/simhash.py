"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints at ``radius`` or fewer differing
bits agree up to a few bits in at least one segment, so each looks up a small Hamming ball of
every segment in a table of segment values and the full distance of each match is verified.

Only distinct fingerprints take part, so copies cost nothing. Dense groups of near copies are
shrunk before the lookup: fingerprints with a common neighbour at one bit are all within two
bits of each other, at most 65 of them per neighbour, and are joined as a star. The lookup then
reports only links between different stars. No link between different texts is lost, and no group
is written out as pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a
null ``id`` takes part but never names a group (a group of nulls only has a null name); repeated
rows stay, each with the same result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.components import components
from watchloom.llm.sieve import without
from watchloom.session import materialize, materialize_counted

BITS = 64


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of the ASCII-lower-cased words, 0 without any."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed long."""

    def batch(texts: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(x.as_py(), shingle, seed) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return F.arrow_udf(batch, "long").asNondeterministic()(text.cast("string"))


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For a job inside: fewer rows at once between JVM and Python, as each may hold a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segment_plan(segments: int, radius: int) -> list[tuple[int, int]]:
    """(mask, ball radius) per segment: within ``radius`` bits, some segment is inside its ball.

    If the first ``radius % segments + 1`` segments differed in more than ``radius // segments``
    bits and the others in at least that many, the sum would exceed ``radius``.
    """
    floor, over = divmod(radius, segments)
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [
        (((1 << hi) - 1) ^ ((1 << lo) - 1), floor if k <= over else floor - 1)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
        if k <= over or floor
    ]


def _ball(mask: int, radius: int) -> list[int]:
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    ball, ring = {0}, {0}
    for _ in range(radius):
        ring = {x | b for x in ring for b in bits if not x & b}
        ball |= ring
    return sorted(ball)


def best_segments(n: int, radius: int) -> int:
    """The number of segments with the least work for ``n`` fingerprints; results never depend on it."""

    def work(m: int) -> float:
        plan = [(len(_ball(mask, r)), mask.bit_count()) for mask, r in segment_plan(m, radius)]
        return sum(size * (1 + n / 2**width) for size, width in plan)

    return min(range(max(2, radius // 2), radius + 2), key=work)


def near_links(prints: DataFrame, n: int, radius: int, segments: int | None = None) -> DataFrame:
    """Distinct ``a``, ``b``: classes with fingerprints at ``radius`` or fewer differing bits.

    ``prints`` has distinct ``fp`` and ``class``; ``n`` is its number of rows.
    """
    plan = segment_plan(segments or best_segments(n, radius), radius)
    table = F.array(*[F.struct(F.lit(k).alias("seg"), F.lit(_signed(mask)).cast("long").alias("mask")) for k, (mask, _) in enumerate(plan)])
    index = prints.select("fp", "class", F.explode(table).alias("x")).select("x.seg", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), F.col("fp").alias("fp_a"), F.col("class").alias("a"))
    balls = [f"named_struct('seg', {k}, 'mask', {_signed(mask)}L, 'flips', array({','.join(str(_signed(f)) + 'L' for f in _ball(mask, r))}))" for k, (mask, r) in enumerate(plan)]
    balls = [b.replace(f"-{1 << 63}L", f"(-{(1 << 63) - 1}L - 1L)") for b in balls]
    probes = (
        prints.select("fp", "class", F.explode(F.expr(f"array({','.join(balls)})")).alias("x"))
        .select("x.seg", "x.mask", F.col("fp").alias("fp_b"), F.col("class").alias("b"), F.explode("x.flips").alias("flip"))
        .select("seg", F.expr("(fp_b & mask) ^ flip").alias("key"), "fp_b", "b")
    )
    near = F.expr("fp_a < fp_b and a != b") & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)
    found = index.join(probes, (index["seg"] == probes["seg"]) & (index["key"] == probes["key"]) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(prints: DataFrame) -> DataFrame:
    """``a``, ``b`` within two bits: all that share a neighbour at one bit, tied to their smallest."""
    flips = "array(0L," + ",".join(f"{1 << i}L" for i in range(BITS - 1)) + f",(-{(1 << 63) - 1}L - 1L))"
    around = prints.select("fp", F.explode(F.expr(flips)).alias("flip")).select(F.expr("fp ^ flip").alias("hub"), "fp")
    # Distinct fingerprints at one bit or less of a hub: 65 at most, so a group's list is bounded.
    stars = around.groupBy("hub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b").distinct()


def component_names(prints: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """``fp``, ``root``, ``name`` per distinct ``fp``: its group's key and smallest ``id``.

    ``prints`` has ``id`` and ``fp`` per row. Links are exact at every ``radius``.
    """
    base, n, _ = materialize_counted(prints.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    if radius >= 2:
        stars = components(_stars(base))
        base = base.join(stars, base["fp"] == stars["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("class"))
    else:
        base = base.withColumn("class", F.col("fp"))
    base = materialize(base, "classes")
    roots = components(near_links(base, n, radius, segments))
    rooted = base.join(roots, base["class"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "class").alias("root"))
    rooted = materialize(rooted, "rooted")
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("id").alias("name")), "root").select("fp", "root", "name")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` (signed), ``name`` of its group."""
    prints = docs.select(docs[f"`{id_col}`"].alias("id"), fingerprint(docs[f"`{text}`"], shingle).alias("fp"))
    with _small_batches(docs.sparkSession):
        prints = materialize(prints, "fingerprints")
    return prints.join(component_names(prints, radius), "fp").select("id", "fp", "name")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of each group of near duplicates: a row with the group's smallest id, nulls last.

    Only slim rows are shuffled; the whole rows that stay are written from where they are read.
    """
    cols = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*cols, docs[f"`{id_col}`"].alias("id"), fingerprint(docs[f"`{text}`"]).alias("fp"), F.monotonically_increasing_id().alias("row"))
    with _small_batches(docs.sparkSession):
        rows = materialize(rows, "rows")  # fixes the row numbers
    slim = rows.select("id", "fp", "row")
    names = component_names(slim, radius)
    first = slim.join(names, "fp").filter(F.col("id").eqNullSafe(F.col("name"))).groupBy("root").agg(F.min("row").alias("row"))
    gone, n, _ = materialize_counted(slim.select("row").join(first.select("row"), "row", "left_anti"), "copies")
    kept = without(rows, F.col("row"), gone, n)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint and the smallest document of its group."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("name").alias("component_id"),
    )
