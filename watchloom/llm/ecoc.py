"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier predicts each bit, and the codeword
with the least weighted loss wins. The weights are each classifier's accuracy on each language,
so a bit that is unreliable for a language counts little there. A small lead over the
second codeword is flagged as ambiguous.

Fitting reads a bounded sample of labelled rows (about ``PER_LANG`` documents of a language, drawn by
a hash of the id); only ``languages x BUCKETS`` counts reach the driver. Prediction reads
every whole text once, without a shuffle, and sees nothing but the text.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if no language was
learned; with one language learned, that language with score 1; rows without language or
id are never learned from; repeated rows are predicted alike; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language that a model is fitted on, on average at most.
PER_LANG = 2000
#: Hashed n-grams of 1 to 3 characters.
BUCKETS = 1 << 14
#: Leads of the best over the second score below this are ambiguous.
CLEAR = 0.2
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


class Grams:
    """Counts of the hashed letter n-grams of a text; words are bounded by single spaces."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.shift = np.uint32(32 - buckets.bit_length() + 1)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)

    def __call__(self, text: str | None) -> np.ndarray | None:
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(codes, 0xFFFF)]
        for k in np.flatnonzero(codes > 0xFFFF):
            letter[k] = chr(codes[k]).isalpha()
        if not letter.any():
            return None
        codes = np.where(letter, codes, np.uint32(32))
        first = np.concatenate([[True], letter[:-1]])
        codes = np.concatenate([[np.uint32(32)], codes[letter | first], [np.uint32(32)]]).astype(np.uint32)
        total = np.zeros(self.buckets, np.int64)
        mixed = codes * _MIX[0]
        for size in (1, 2, 3):
            if size > 1:
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MIX[size - 1] + codes[size - 1 :] * _MIX[0]
            hashed = (mixed ^ (mixed >> np.uint32(16))) * _MIX[1] >> self.shift
            total += np.bincount(hashed, minlength=self.buckets)
        return total


def codebook(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1: all splits up to 7 languages, else the farthest apart of random ones."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        # The first word has all ones; word k alternates in runs of 2 ** (n - 1 - k).
        return np.array([[1 if not k else -1 if (b >> (n - 1 - k)) & 1 else 1 for b in range(1, bits + 1)] for k in range(n)], np.int8)
    random, bits = np.random.default_rng(42), 10 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(64):
        code = random.choice(np.array([-1, 1], np.int8), (n, bits))
        gram = code.astype(np.int32) @ code.T
        np.fill_diagonal(gram, -bits)
        apart = (bits - gram.max()) // 2
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


class Model:
    """``langs``, ``code``, per-bit n-gram ``weights``, ``scale`` of their margins, ``trust`` per language and bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codebook(len(langs))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        columns = []
        for bit in self.code.T:
            one, zero = share[bit > 0], share[bit < 0]
            columns.append(np.log(one.mean(axis=0) / zero.mean(axis=0)) if len(one) and len(zero) else np.zeros(counts.shape[1]))
        self.weights = np.array(columns, np.float32).T
        self.scale = np.ones(self.code.shape[1])
        self.trust = np.full(self.code.shape, 1.0 / self.code.shape[1])

    @classmethod
    def of(cls, state: dict) -> Model:
        """A model from its ``vars``: those are plain data, which a worker can load without the library."""
        model = cls.__new__(cls)
        vars(model).update(state)
        return model

    def margins(self, counts: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(counts)
        return (counts[some] @ self.weights[some]) / counts.sum() / self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -2 * self.code * margins)).sum(axis=1)

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, str | None, bool]:
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, None, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, None, False
        loss = self.losses(self.margins(counts))
        share = np.exp(4 * (loss.min() - loss))
        share /= share.sum()
        first, second = np.argsort(-share, kind="stable")[:2]
        return self.langs[first], float(min(share[first], 1.0)), self.langs[second], bool(share[first] - share[second] < CLEAR)


def sample(docs: DataFrame, id_col: str, lang: str, per_lang: int = PER_LANG) -> DataFrame:
    """The labelled rows to learn from: a share of each language's ids, by their hash."""
    own = docs.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    sizes = own.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    steps = 1 << 30
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample")), F.lit(steps))
    bounds = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, min(steps, steps * per_lang // n))]) if sizes else F.lit(None).cast("map<string,long>")
    return own.filter(draw < F.element_at(bounds, F.col(lang).cast("string") if not sizes else F.col(lang)))


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", buckets: int = BUCKETS) -> Model:
    """A model from all rows of ``labelled``; use ``sample`` to bound them."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null")

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found = Grams(buckets), {}
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                if (counts := grams(body.as_py())) is not None:
                    found[name.as_py()] = found.get(name.as_py(), 0) + counts
        for name, counts in found.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(some), "bucket": some.astype(np.int32), "n": counts[some]})

    sums = rows.mapInArrow(gram_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most languages x buckets rows
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), buckets))
    place = {x: i for i, x in enumerate(langs)}
    at = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    model = Model(langs, counts)
    if len(langs) < 2:
        return model

    shared = spark.sparkContext.broadcast(vars(model))

    def trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, n_bits, model = Grams(buckets), {}, model_bits, Model.of(shared.value)
        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                if (found := grams(body.as_py())) is not None:
                    m = model.margins(found)
                    right = model.code[model.langs.index(name.as_py())] * m > 0
                    old = seen.get(name.as_py(), np.zeros((3, n_bits)))
                    seen[name.as_py()] = old + np.array([right, np.abs(m), np.ones(n_bits)])
        for name, v in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * n_bits, "bit": np.arange(n_bits, dtype=np.int32), "right": v[0], "margin": v[1], "n": v[2]})

    model_bits = model.code.shape[1]
    tried = rows.mapInArrow(trials, "lang string, bit int, right double, margin double, n double").groupBy("lang", "bit")
    rights, margin, ns = (np.zeros(model.code.shape) for _ in range(3))
    for r in tried.agg(F.sum("right").alias("right"), F.sum("margin").alias("margin"), F.sum("n").alias("n")).collect():  # languages x bits rows
        k = place[r["lang"]], r["bit"]
        rights[k], margin[k], ns[k] = r["right"], r["margin"], r["n"]
    accuracy = np.clip(rights / np.maximum(ns, 1), 0.01, 1)
    model.trust = accuracy / accuracy.sum(axis=1, keepdims=True)
    model.scale = np.maximum((margin / np.maximum(ns, 1)).mean(axis=0), 1e-6)
    return model


def predict(model: Model, docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> Column:
    """Struct ``lang_pred``, ``score``, ``second``, ``ambiguous`` for ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    own: list = []

    def batch(texts: pa.Array) -> pa.Array:
        if not own:
            own.extend((Grams(buckets), Model.of(shared.value)))
        rows = [own[1].predict(own[0](x.as_py())) for x in texts]
        kinds = (pa.string(), pa.float64(), pa.string(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang_pred", "score", "second", "ambiguous"])

    kind = "lang_pred string, score double, second string, ambiguous boolean"
    return F.arrow_udf(batch, kind).asNondeterministic()(docs[f"`{text}`"].cast("string"))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op5_language_codes(spark, sf_dir: str) -> DataFrame:
    """One row per document: predicted language, score, second choice and flag; fitted on the rows not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(sample(docs.filter(~held_out("doc_id")), "doc_id", "lang"))
    found = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), predict(model, docs).alias("p"))
    return found.select("doc_id", "held_out", "p.*")
