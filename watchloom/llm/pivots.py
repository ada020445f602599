"""Vector codes by product quantisation in whole numbers, its assignments pruned by fixed pivots (LAESA).

A vector's components become whole numbers and are cut into equal parts; each part position has
a codebook of up to 16 entries. The distances of every part to a few pivots, fixed for good, are
computed once and stored with the vectors. In every round only the distances between pivots and
entries are new: by the triangle inequality their differences bound each part's distance to each
entry from below. Entries are tried in the order of the bounds and a part is done when the next bound
exceeds its best exact distance, so most squared distances are never evaluated, and none is estimated.

A round is one scan of the stored vectors without a shuffle of them: tasks add up the parts of each
entry, the driver gets entries x dimension sums. Broadcast are the codebooks, 16 x dimension numbers.

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped; so is one
whose length isn't that of the first vector (smallest id) whose length is a positive multiple of the
number of parts; repeated rows are coded and counted each, an id opens one entry only, with its smallest
vector; null ids come last; fewer ids than entries give fewer entries; equal distances go to the lower
entry; null labels are one label; no vector kept gives no rows. Squares must fit a long: a whole number over
``limit(dimension)`` (2 ** 26 for 64 components) is an error. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Pivots of each part position.
PIVOTS = 4
#: Rows assigned at once inside a task.
BLOCK = 4096
#: Stored distances are rounded to 24 bits; bounds give way by a little more than that.
_SLACK = 1e-6


def limit(dimension: int) -> int:
    """Largest absolute component for which ``dimension`` squared differences fit a long."""
    return 1 << (60 - dimension.bit_length()) // 2


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that must go."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of (entries, width) the first and then always the farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(count, len(entries)):
        near = np.min([squared(entries, entries[k]) for k in chosen], axis=0)
        chosen.append(int(near.argmax()))
    return entries[chosen]


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of parts (rows, positions, width) to pivots (positions, pivots, width)."""
    return np.sqrt(squared(parts[:, :, None, :], pivots[None]).astype(np.float64)).astype(np.float32)


def nearest(parts: np.ndarray, stored: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For parts (rows, width) of one position: lowest nearest entry, squared distance, evaluations made."""
    far = np.sqrt(squared(pivots[:, None], entries[None]).astype(np.float64))  # pivots x entries
    stored = stored.astype(np.float64)[:, :, None]
    bounds = (np.abs(stored - far) - _SLACK * (stored + far)).max(axis=1)
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    code = order[:, 0]
    best = squared(parts, entries[code])
    open_rows, evaluated = np.arange(len(parts)), len(parts)
    for rank in range(1, len(entries)):
        # Bounds only grow from here: a row that is done stays done.
        open_rows = open_rows[bounds[open_rows, rank] <= np.sqrt(best[open_rows].astype(np.float64)) * (1 + _SLACK)]
        if not len(open_rows):
            break
        entry = order[open_rows, rank]
        found = squared(parts[open_rows], entries[entry])
        evaluated += len(open_rows)
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (entry < code[open_rows]))
        rows = open_rows[better]
        code[rows], best[rows] = entry[better], found[better]
    return code, best, evaluated


class Books:
    """``entries`` (positions, entries, width) and the fixed ``pivots`` (positions, pivots, width)."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_entries(base: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, np.ndarray]:
    """The dimension and the vectors of the smallest ids; ``base`` has ``id`` and ``v``."""
    whole = base.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    by_id = F.col("id").asc_nulls_last()
    one = whole.orderBy(by_id, "v").select(F.size("v")).first()
    if one is None:
        return 0, np.zeros((0, 0), np.int64)
    same = whole.filter(F.size("v") == one[0])
    ids = [r[0] for r in same.select("id").distinct().orderBy(by_id).limit(entries).collect()]
    own = F.col("id").isin([i for i in ids if i is not None])
    rows = same.filter(own | F.col("id").isNull() if None in ids else own).groupBy("id").agg(F.min("v").alias("v")).orderBy(by_id).collect()
    return one[0], np.array([r["v"] for r in rows], np.int64)


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES) -> tuple[DataFrame, Books] | None:
    """The stored table (``id``, ``label``, ``v``, ``far``: distances to the pivots) and the first codebooks."""
    v = whole_numbers(vectors[f"`{vector}`"])
    base = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{label}`"].alias("label"), v.alias("v")).filter("v is not null")
    dimension, firsts = first_entries(base, parts, entries)
    if not dimension:
        return None
    width = dimension // parts
    most = limit(dimension)
    first = firsts.reshape(len(firsts), parts, width).transpose(1, 0, 2)
    pivots = np.array([choose_pivots(book) for book in first])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
            if len(v) and max(int(v.max()), -int(v.min())) > most:
                raise ValueError(f"a component over {most} can't be squared in a long")
            far = [to_pivots(v[k : k + BLOCK], pivots).ravel() for k in range(0, len(v), BLOCK)]
            far = np.concatenate(far) if far else np.zeros(0, np.float32)
            step = parts * pivots.shape[1]
            far = pa.ListArray.from_arrays(np.arange(0, len(far) + 1, step, dtype=np.int32), pa.array(far, pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), far], ["id", "label", "v", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    stored = base.filter(F.size("v") == dimension).mapInArrow(distances, f"id {kinds['id']}, label {kinds['label']}, v array<bigint>, far array<float>")
    return materialize(stored, "pivoted"), Books(first, pivots)


def _assigned(batch: pa.RecordBatch, books: Books) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, parts, codes and squared distances of each block of a batch."""
    positions, _, width = books.entries.shape
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, positions, width)
    far = batch.column("far").flatten().to_numpy(zero_copy_only=False).reshape(len(v), positions, -1)
    for k in range(0, len(v), BLOCK):
        some, stored = v[k : k + BLOCK], far[k : k + BLOCK]
        found = [nearest(some[:, p], stored[:, p], books.entries[p], books.pivots[p])[:2] for p in range(positions)]
        yield k, some, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def refine(stored: DataFrame, books: Books) -> Books:
    """One round: entries become the floor of the mean of their parts; unused entries stay."""
    positions, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), object)
        for batch in batches:
            for _, some, codes, _ in _assigned(batch, books):
                for p in range(positions):
                    by_entry = np.zeros((entries, width), np.int64)
                    np.add.at(by_entry, codes[:, p], some[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    total[p] += by_entry
        used = np.argwhere(count)
        flat = {"place": pa.array((used[:, 0] * entries + used[:, 1]).astype(np.int32)), "n": pa.array(count[count > 0])}
        flat["total"] = pa.array([[str(x) for x in total[p, e]] for p, e in used], pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict(flat)

    tasks = stored.mapInArrow(sums, "place int, n long, total array<string>").select("place", "n", F.posexplode("total").alias("k", "x"))
    found = tasks.groupBy("place", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # entries x dimension
    now = books.entries.copy().reshape(-1, width)
    for r in found:
        now[r["place"], r["k"]] = int(r["x"]) // r["n"]
    return Books(now.reshape(books.entries.shape), books.pivots)


def encode(stored: DataFrame, books: Books) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits a part) and ``error`` (squared distances)."""
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, found, error in _assigned(batch, books):
                rows = batch.slice(k, len(found))
                text = pa.array([r.tobytes().hex() for r in found.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), text, pa.array(error.sum(axis=1))], ["id", "label", "code", "error"])

    return stored.select("id", "label", "v", "far").mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """Codes of all vectors kept, with ``label_error``, and the codebooks they mean (None without vectors)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    ready = prepare(vectors, id_col, vector, label, parts, entries)
    if ready is None:
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
        return vectors.sparkSession.createDataFrame([], f"id {kinds[id_col]}, label {kinds[label]}, code string, error long, label_error long"), None
    stored, books = ready
    for _ in range(rounds):
        before, books = books, refine(stored, books)
        if np.array_equal(before.entries, books.entries):
            break  # further rounds would change nothing
    coded = materialize(encode(stored, books), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same"))).select("id", "label", "code", "error", "label_error"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """One row per vector kept: its code, its error, its label's error and the digest of the codebooks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    codes, books = compress(vectors)
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds as SQL, every distance evaluated."""
    steps = [
        f"""v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) ints from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
        f"""x as materialized (select vec_id, p, ints[p * (len(ints) // {PARTS}) + 1 : (p + 1) * (len(ints) // {PARTS})] part from v, range({PARTS}) r(p))""",
        f"""seeds as (select vec_id, row_number() over (order by vec_id) - 1 e from (select distinct vec_id from v order by 1 limit {ENTRIES}))""",
        "b0 as materialized (select p, e, part entry from x join seeds using (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} as materialized (
  select vec_id, p, min(d * {ENTRIES} + e) % {ENTRIES} e, min(d) d
  from (select vec_id, x.p, e, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i])))::bigint d from x join b{k} b on b.p = x.p)
  group by 1, 2)""")
        if k < ROUNDS:
            steps.append(f"""m{k} as (
  select p, e, list((((s - ((s % n) + n) % n) // n))::bigint order by i) entry
  from (select p, e, i, sum(c)::bigint s, count(*)::bigint n
        from (select x.p, a.e, unnest(part) c, unnest(range(len(part))) i from x join a{k} a on a.vec_id = x.vec_id and a.p = x.p) group by 1, 2, 3) group by 1, 2)""")
            steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(m.entry, b.entry) entry from b{k} b left join m{k} m on m.p = b.p and m.e = b.e)")
    steps.append(f"digest as (select sha256(string_agg(c::varchar, ',' order by p, e, i)) codebooks_sha256 from (select p, e, unnest(entry) c, unnest(range(len(entry))) i from b{ROUNDS}))")
    steps.append(f"codes as (select vec_id, string_agg(printf('%02x', e::int), '' order by p) code, sum(d)::bigint error from a{ROUNDS} group by 1)")
    return (
        "with "
        + ",\n".join(steps)
        + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from codes join v using (vec_id), digest"
    )


OP13_SQL = _sql()
