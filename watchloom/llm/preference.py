"""Document quality by Bradley-Terry scores learned from preference pairs.

A text becomes ``FEATURES`` shape measures (length, repetition, symbols, case, lines), each
cut at quantiles of the learning rows into steps. A document's score is the sum of its steps'
weights; the weights maximise the likelihood that in a pair of a good and a bad document the
good one wins, ``sigmoid(score difference)``: logistic loss on feature differences, by Newton
steps. Documents pass from the score quantile on below which the labels put the bad share.

Fitting reads all labelled rows and stays on Spark: their measures are a stored table, cuts and the
passing score come from counts over all of them, and every row of the larger class meets ``PARTNERS``
of the other, by an equi-join on places in the order of a hash of the id. A Newton step is one scan of
these pairs. What reaches the driver doesn't grow with the rows: counts of values of ``DIGITS`` binary digits, of
raw scores in steps of 1 / ``GRID``, and sums over cuts. Sums are of whole numbers, so a model doesn't depend on
how rows are dealt. Prediction sees nothing but the text.

Defined results: a null or empty text has all measures zero and a score like any other; with no
label learned every score is 0.5, with one label it is that label; rows whose label is neither 0
nor 1, or that have no id, are never learned from; several labels of one id count as its smallest;
repeated rows are scored alike and are
learned from once, by their least measures; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.ranking import ordinal
from watchloom.session import materialize, materialize_observed

#: Opponents of each document.
PARTNERS = 8
#: Cuts of each measure, strength of the pull to zero, Newton steps.
CUTS, PULL, STEPS = 12, 1.0, 12
#: Scores from here on are predicted good.
PASS = 0.3
FEATURES = 18
#: Binary digits of a measure when cuts are placed, steps of the raw scores when the floor is.
DIGITS, GRID = 11, 1024
#: Parts of one that the terms of a pair are rounded to.
EXACT = 1 << 24
_SYMBOLS = "#$%&*|<>{}[]~^_=+\\/@"
_ENDS = ".!?:;\"')"


class Measures:
    """The shape measures of a text."""

    def __init__(self):
        kinds = np.zeros(0x10000, np.uint8)  # bit 0 letter, 1 upper case, 2 digit, 3 space, 4 symbol, 5 exclamation
        for c in range(0x10000):
            x = chr(c)
            kinds[c] = x.isalpha() | x.isupper() << 1 | x.isdigit() << 2 | x.isspace() << 3 | (x in _SYMBOLS) << 4 | (x in "!?") << 5
        self.kinds = kinds

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        words = (text or "").split()
        if not words:
            return out
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        tally = np.bincount(self.kinds[np.minimum(codes, 0xFFFF)], minlength=64)
        has = lambda bit: int(tally[np.arange(64) >> bit & 1 == 1].sum())
        letters, seen, n = has(0), len(codes) - has(3), len(words)
        counts = Counter(words)
        pairs = Counter(zip(words, words[1:], strict=False))
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        out[:] = (
            np.log1p(n),
            letters / seen,
            has(1) / max(letters, 1),
            has(2) / seen,
            has(4) / seen,
            has(5) / seen,
            len(counts) / n,
            max(counts.values()) / n,
            sum(c for c in pairs.values() if c > 1) / max(n - 1, 1),
            seen / n,
            1 - len(set(lines)) / len(lines),
            sum(x.rstrip()[-1] in _ENDS for x in lines) / len(lines),
            np.log1p(n / len(lines)),
            sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / n,
            sum(c for w, c in counts.items() if len(w) == 1) / n,
            sum(c for w, c in counts.items() if w[0].isupper() and not w.isupper()) / n,
            sum(c for w, c in counts.items() if w[-1] in ".,;:") / n,
            sum(c for w, c in counts.items() if len(w) <= 3) / n,
        )
        return out


class Model:
    """``cuts`` of each measure, ``weights`` of the steps, ``floor``: the raw score that just passes."""

    def __init__(self, learned: Learned, n_good: int, n_bad: int):
        """``n_good`` and ``n_bad`` are the labelled ids in all, whether ``learned`` holds their texts or not."""
        good, bad = learned.sizes
        self.constant = None if good and bad else 0.5 if not len(learned) else float(good > 0)
        if self.constant is not None:
            return
        inner = np.linspace(0, 1, CUTS + 2)[1:-1]
        of, values, share = learned.values()
        self.cuts = np.array([_quantiles(values[of == k], share[of == k], inner) for k in range(FEATURES)])
        pairs = learned.pairs(self.cuts, partners := min(PARTNERS, good, bad))
        self.weights = _newton(lambda weights: _spark_sums(pairs, weights), FEATURES * CUTS, partners)
        raw, of_good, rows = learned.raw(vars(self))
        rows = rows * np.where(of_good, n_good / good, n_bad / bad)
        first = float(_quantiles(raw, rows / rows.sum(), np.array([n_bad / (n_good + n_bad)]))[0])
        # Halfway to the end of the last step that fails.
        self.floor = (first + max((float(x) + 1 for x in raw[raw < first]), default=first)) / 2 / GRID

    @classmethod
    def of(cls, state: dict) -> Model:
        """A model from its ``vars``: those are plain data, which a worker can load without the library."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def raw(self, measures: np.ndarray) -> np.ndarray:
        """Sums of the weights row by row: a text's score must not depend on the rows beside it."""
        return (self.steps(measures) * self.weights).sum(axis=1)

    def steps(self, measures: np.ndarray) -> np.ndarray:
        """One row per document: for every cut of every measure whether it is exceeded."""
        return (measures[:, :, None] > self.cuts[None]).reshape(len(measures), -1).astype(np.float64)

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """0 to 1: the chance to win against a document at the floor, whose own score is ``PASS``."""
        if self.constant is not None:
            return np.full(len(measures), self.constant)
        raw = self.raw(measures)
        chance = _sigmoid(raw - self.floor + np.log(PASS / (1 - PASS)))
        # The document at the floor itself passes, whatever the rounding.
        return np.where(raw >= self.floor, np.maximum(chance, PASS), np.minimum(chance, np.nextafter(PASS, 0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _quantiles(values: np.ndarray, share: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest values whose own and lower shares exceed ``at``."""
    order = np.argsort(values, kind="stable")
    up = np.cumsum(share[order])
    return values[order][np.minimum(np.searchsorted(up, at + 1e-9, side="right"), len(values) - 1)]


def _turns(n_good: int, n_bad: int, partners: int) -> list[int]:
    """By how many places the bad rows are moved on before the rows meet, once for each opponent."""
    return [k * (n_bad // partners or 1) for k in range(partners)]


def _sums(d: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and bend of the loss over rows of differences, in parts of ``EXACT``: whole sums where differences are."""
    lose = _sigmoid(-(d @ weights))
    return d.T @ np.rint(lose * EXACT), (d * np.rint(lose * (1 - lose) * EXACT)[:, None]).T @ d


def _newton(sums: Callable, width: int, partners: int) -> np.ndarray:
    """Weights with the least logistic loss over all pairs, whose slope and bend ``sums`` gives."""
    weights = np.zeros(width)
    for _ in range(STEPS):
        slope, bend = (x / (EXACT * partners) for x in sums(weights))
        step = np.linalg.solve(PULL * np.eye(width) + bend, PULL * weights - slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _fit(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The weights for rows in memory, paired as ``Learned.pairs`` does."""
    n, partners = max(len(good), len(bad)), min(PARTNERS, len(good), len(bad))
    at = np.arange(n)
    d = np.concatenate([good[at % len(good)] - bad[(at + move) % len(bad)] for move in _turns(len(good), len(bad), partners)])
    return _newton(lambda weights: _sums(d, weights), good.shape[1], partners)


def _spark_sums(pairs: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_sums`` over a table of pairs: one partial sum a task, added up in a few groups of tasks."""
    width = len(weights)
    ladder = np.tri(CUTS + 1, CUTS, -1)  # steps of each level of a measure

    def steps(levels: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(levels.to_pylist()), np.uint8)
        return ladder[raw].reshape(len(levels), width)

    def row(slope: np.ndarray, bend: np.ndarray) -> dict:
        return {"slope": pa.array([slope], pa.list_(pa.float64())), "bend": pa.array([bend.ravel()], pa.list_(pa.float64()))}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.slice(k, 2048)
                found = _sums(steps(part.column(0)) - steps(part.column(1)), weights)
                slope, bend = slope + found[0], bend + found[1]
        yield pa.RecordBatch.from_pydict(row(slope, bend))

    def add(table: pa.Table) -> pa.Table:
        return pa.table(row(*(total(table, c) for c in ("slope", "bend"))))

    def total(table: pa.Table, name: str) -> np.ndarray:
        return np.sum([np.asarray(x.values) for x in table.column(name)], axis=0)

    shape = "slope array<double>, bend array<double>"
    some = pairs.mapInArrow(task, shape).groupBy((F.spark_partition_id() % 8).alias("part")).applyInArrow(add, shape).toArrow()
    return total(some, "slope"), total(some, "bend").reshape(width, width)


class Learned:
    """The rows to learn from as a stored table: label, place inside the class, measures of ``DIGITS`` digits."""

    def __init__(self, rows: DataFrame):
        """``rows``: (__id, __good, m), one row per id."""
        ordered = rows.select("__good", F.xxhash64(F.col("__id").cast("string"), F.lit("quality pairs")).alias("__hash"), F.col("__id").cast("string").alias("__id"), "m")
        # Neighbours in this order have nothing in common, and it is the same however rows are dealt.
        placed = ordinal(ordered, ["__good"], ["__hash", "__id"], "place").select("__good", (F.col("place") - 1).alias("place"), "m")
        self.frame, seen = materialize_observed(placed, "preference-rows", n=F.count(F.lit(1)), good=F.count_if(F.col("__good") == 1))
        self.sizes = (seen["good"], seen["n"] - seen["good"])

    def __len__(self) -> int:
        return sum(self.sizes)

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(measure, value, share of the rows): each value once a class, both classes alike in weight.

        Bounded by the values of so few digits: a share of one down to a millionth has 20 x 1024 of them."""
        seen = self.frame.select("__good", F.posexplode("m").alias("of", "value")).groupBy("__good", "of", "value").count().toArrow()
        good, of, value, n = (seen.column(c).to_numpy() for c in ("__good", "of", "value", "count"))
        order = np.lexsort((good, value, of))
        share = n * np.where(good == 1, 0.5 / self.sizes[0], 0.5 / self.sizes[1])
        return of[order], value.astype(np.float64)[order], share[order]

    def pairs(self, cuts: np.ndarray, partners: int) -> DataFrame:
        """(good, bad): the levels of both rows of each pair, a byte for every measure."""

        def levels(rows: pa.Array) -> pa.Array:
            m = rows.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
            found = (m[:, :, None] > cuts[None]).sum(axis=2).astype(np.uint8)
            return pa.array([x.tobytes() for x in found], pa.binary())

        known = self.frame.select("__good", "place", F.arrow_udf(levels, "binary").asNondeterministic()("m").alias("levels"))
        known = materialize(known, "preference-levels")
        n_good, n_bad = self.sizes
        good, bad = (known.where(F.col("__good") == k).select("place", F.col("levels").alias(name)) for k, name in ((1, "good"), (0, "bad")))
        move = F.explode(F.array(*[F.lit(x).cast("long") for x in _turns(n_good, n_bad, partners)])).alias("move")
        if n_good >= n_bad:
            met = good.select("good", "place", move).select("good", F.pmod(F.col("place") + F.col("move"), F.lit(n_bad)).alias("place")).join(bad, "place")
        else:
            met = bad.select("bad", "place", move)
            met = met.select("bad", F.pmod(F.pmod(F.col("place") - F.col("move"), F.lit(n_bad)), F.lit(n_good)).alias("place")).join(good, "place")
        return materialize(met.select("good", "bad"), "preference-pairs")

    def raw(self, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(raw score in whole steps of 1 / ``GRID``, class, rows) of a model given as its ``vars``."""
        own: list = []

        def batch(rows: pa.Array) -> pa.Array:
            if not own:
                own.append(Model.of(state))
            m = rows.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES)
            return pa.array(np.floor(own[0].raw(m) * GRID).astype(np.int64))

        stepped = self.frame.select("__good", F.arrow_udf(batch, "long").asNondeterministic()("m").alias("raw"))
        seen = stepped.groupBy("__good", "raw").count().toArrow()
        good, raw, n = (seen.column(c).to_numpy() for c in ("__good", "raw", "count"))
        order = np.lexsort((good, raw))
        return raw[order], good[order] == 1, n[order]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", per_class: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The rows of ``docs`` to learn from, with ``__good``, and the number of labelled ids of each class.

    These are all that have a label. For trials ``per_class`` draws about so many ids of each label by a hash."""
    own = labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull())
    own = own.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.min(F.col(f"`{label}`")).cast("int").alias("__good"))
    sizes = {r["__good"]: r["n"] for r in own.groupBy("__good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if per_class is not None:
        steps = 1 << 30
        draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("quality sample")), F.lit(steps))
        good, bad = (F.lit(min(steps, steps * per_class // max(sizes.get(k, 1), 1))) for k in (1, 0))
        own = own.filter(draw < F.when(F.col("__good") == 1, good).otherwise(bad))
    return docs.join(own, docs[f"`{id_col}`"] == F.col("__id")), sizes


def measure(text: Column) -> Column:
    """The measures of a text as an array of doubles."""
    own: list = []

    def batch(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Measures())
        flat = np.concatenate([own[0](x.as_py()) for x in texts]) if len(texts) else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(0, FEATURES * len(texts) + 1, FEATURES, dtype=np.int32), flat)

    return F.arrow_udf(batch, "array<double>").asNondeterministic()(text.cast("string"))


def _coarse(m: Column) -> Column:
    """Measures rounded up to ``DIGITS`` binary digits: a cut that is such a value parts them as it parts the measures."""

    def batch(rows: pa.Array) -> pa.Array:
        drop = 53 - DIGITS
        bits = (rows.flatten().to_numpy() + 0.0).view(np.int64)
        flat = ((bits + (1 << drop) - 1) >> drop << drop).view(np.float64).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32), flat)

    return F.arrow_udf(batch, "array<float>").asNondeterministic()(m)


def fit(drawn: DataFrame, sizes: dict[int, int], text: str = "text", measures: str | None = None) -> Model:
    """A model from the rows and class sizes that ``sample`` gives; ``measures`` names a column of measures taken already."""
    m = F.col(f"`{measures}`") if measures else measure(F.col(f"`{text}`"))
    rows = drawn.select("__id", "__good", _coarse(m).alias("m"))
    # One row per id, however often it repeats.
    return Model(Learned(rows.groupBy("__id").agg(F.min("__good").alias("__good"), F.min("m").alias("m"))), sizes.get(1, 0), sizes.get(0, 0))


def predict(model: Model, docs: DataFrame, text: str = "text", measures: str | None = None) -> Column:
    """Scores of ``text``, 0 to 1; ``measures`` names a column of its measures taken already."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    own: list = []

    def batch(rows: pa.Array) -> pa.Array:
        if not own:
            own.append(Model.of(shared.value))
        return pa.array(own[0].scores(rows.flatten().to_numpy().reshape(-1, FEATURES)))

    m = docs[f"`{measures}`"] if measures else measure(docs[f"`{text}`"])
    return F.arrow_udf(batch, "double").asNondeterministic()(m)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op11_preference_scores(spark, sf_dir: str) -> DataFrame:
    """One row per document: score and verdict; learned from the labels of the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = materialize(docs.select("doc_id", measure(F.col("text")).alias("m")), "preference-measures")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(*sample(docs, labels.filter(~held_out("doc_id"))), measures="m")
    found = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), predict(model, docs, measures="m").alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
