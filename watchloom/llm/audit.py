"""Interaction audit of a set of filters by contracting contingency tensors.

Every row fails some of the filters: one pass finds its failures, and rows are counted per part
in a tensor with one axis of two places (passes, fails) per filter. Whatever order the filters
are applied in, what a step removes, keeps or finds gone already is a contraction of that tensor
with "passes", "fails" or "all" along each axis, so all orders cost one pass over the texts.

The last filter, a copy of an earlier row's text, needs the smallest id of each text: texts are
compared by SHA-256, ids are reduced before the shuffle, and only (id, digest, failures) is ever
shuffled or written. A tensor has 32 cells, and a task holds those of a few parts.

Defined results: a null part is the empty string and a null text the empty text; a row with a null
id never counts as a copy and is a smaller id for nobody; equal rows of one id are no copies of
each other; a label row counts for its id if any label of that id does; rows without labels are
neither good nor toxic; an empty table has no parts and no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.binding import bound
from watchloom.session import materialize

#: The filters by name; a cell's place has the first filter as its highest bit.
FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
_SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of an axis.
PASSES, FAILS, ALL = (1, 0), (0, 1), (1, 1)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part: str = "source", text: str = "text", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``part``, ``cell``, ``n``, ``good``, ``toxic``: rows per part and combination of failures."""
    body = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", _SPACES), "")
    counts = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("different")))
    length = F.char_length("t").cast("long")
    capitals = length - F.char_length(F.translate("t", _UPPER, ""))
    told = body.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), counts.alias("w"), length.alias("length"), capitals.alias("capitals"), F.col("t").rlike(r"[#$%&*|]").alias("d"))
    fails = [F.col("w.n") < 200, 100 * F.col("w.different") < 50 * F.col("w.n"), 100 * F.col("capitals") > 2 * F.col("length"), F.col("d")]
    cell = sum((f.cast("int") * (16 >> i) for i, f in enumerate(fails)), F.lit(0))
    rows = materialize(told.select("id", "part", "digest", cell.alias("cell")), "failures")
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    # The join key holds the id, so a text of very many copies is spread over all tasks.
    copies = rows.join(first.select(F.col("digest").alias("own"), "first"), (F.col("digest") == F.col("own")) & (F.col("id") == F.col("first")), "left")
    copies = copies.select("id", "part", (F.col("cell") + (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")).alias("cell"))
    marks = labels.filter(labels[f"`{id_col}`"].isNotNull()).groupBy(labels[f"`{id_col}`"].alias("labelled"))
    marks = marks.agg(*[F.max(F.coalesce(labels[f"`{c}`"] == 1, F.lit(False)).cast("long")).alias(name) for c, name in ((quality, "good"), (toxic, "toxic"))])
    every = copies.join(marks, F.col("id") == F.col("labelled"), "left")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in MEASURES[1:]]
    return every.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), *sums)


def selections(orders: list[str]) -> dict[str, np.ndarray]:
    """Per contraction, for every step of every order, the places chosen along each axis."""
    chosen = {k: [] for k in ("kept", "removed", "failing", "unique")}
    for order in orders:
        for step, name in enumerate(order):
            before, this = set(order[:step]), {name}
            chosen["kept"].append([PASSES if f in before | this else ALL for f in FILTERS])
            chosen["removed"].append([FAILS if f in this else PASSES if f in before else ALL for f in FILTERS])
            chosen["failing"].append([FAILS if f in this else ALL for f in FILTERS])
            chosen["unique"].append([FAILS if f in this else PASSES for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in chosen.items()}


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums over the chosen places: (..., 2, 2, 2, 2, 2) and (steps, 5, 2) give (..., steps)."""
    return np.einsum("...abcde,sa,sb,sc,sd,se->...s", tensors, *chosen.transpose(1, 0, 2), optimize="greedy")


def audit(counted: DataFrame) -> DataFrame:
    """All orders of the filters for the parts of ``counted`` (as from ``cells``), one row per step."""
    entry = F.struct("cell", *MEASURES)
    tensors = counted.groupBy("part").agg(F.sort_array(F.collect_list(entry)).alias("cells"))  # 32 at most
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = ["".join(p) for p in permutations(FILTERS)]
        chosen = selections(orders)
        letters = np.array([FILTERS.index(name) for order in orders for name in order])
        for batch in batches:
            for place in range(0, len(batch), 64):
                some = batch.slice(place, 64)
                table = np.zeros((len(some), len(MEASURES), 2 ** len(FILTERS)), np.int64)
                for i, row in enumerate(some.column("cells").to_pylist()):
                    for c in row:
                        table[i, :, c["cell"]] = [c[m] for m in MEASURES]
                tensors = table.reshape(*table.shape[:2], *[2] * len(FILTERS))
                removed = contract(tensors, chosen["removed"])
                rows = tensors[:, 0]
                worth = np.stack([removed[:, 0, letters == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
                values = (contract(rows, chosen["kept"]), removed[:, 0], contract(rows, chosen["failing"]) - removed[:, 0], contract(rows, chosen["unique"]), removed[:, 1], removed[:, 2], worth[:, letters])
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": some.column("part").take(pa.array(np.repeat(np.arange(len(some)), len(letters)))),
                        "filter_order": pa.array([o for o in orders for _ in FILTERS] * len(some)),
                        "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) * len(some))),
                    }
                    | {name: pa.array(v.ravel()) for name, v in zip(names, values, strict=True)}
                )

    return tensors.mapInArrow(steps, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per source, order and step: what five filters keep, remove, find gone, and cost in good documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(cells(docs, labels))


OP12_SQL = rf"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') w from documents),
first as (select t, min(doc_id) f from d group by 1),
marks as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
c as (
  select part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) c,
         regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > f, false) e, coalesce(good, 0) good, coalesce(toxic, 0) toxic
  from d join first using (t) left join marks using (doc_id)),
cell as (
  select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end fails,
         count(*) n, sum(good) good, sum(toxic) toxic from c group by 1, 2),
letter(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.x || b.x || c.x || d.x || e.x o from letter a, letter b, letter c, letter d, letter e
  where b.x <> a.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
met as (
  select part, o, fails, n, good, toxic,
         list_min([case when contains(fails, x) then instr(o, x) else 6 end for x in ['A', 'B', 'C', 'D', 'E']]) at_step
  from cell, orders),
r as (
  select part, o filter_order, step::int step, substr(o, step::int, 1) f, sum(case when at_step > step then n else 0 end)::bigint kept,
         sum(case when at_step = step then n else 0 end)::bigint removed,
         sum(case when at_step < step and contains(fails, substr(o, step::int, 1)) then n else 0 end)::bigint redundant,
         sum(case when fails = substr(o, step::int, 1) then n else 0 end)::bigint unique_fails,
         sum(case when at_step = step then good else 0 end)::bigint good_lost,
         sum(case when at_step = step then toxic else 0 end)::bigint toxic_lost
  from met, range(1, 6) s(step) group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from r
"""
