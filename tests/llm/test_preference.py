import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from watchloom.llm import preference as P

from .fixtures import documents, rows

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_documents_are_ranked_right(spark):
    out = P.op11_preference_scores(spark, MEDIUM)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    got = out.collect()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {r[0]: r[1] == 0 for r in docs.selectExpr("doc_id", "crc32(cast(cast(doc_id as string) as binary)) % 5").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    unseen = [(r["score"], r["predicted"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    good, bad = [s for s, _, q in unseen if q], [s for s, _, q in unseen if not q]
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p == q for _, p, q in unseen]) > 0.95


def test_independent_of_how_rows_are_dealt(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet")
    models = [P.fit(*P.sample(d, labels)) for d in (docs, docs.repartition(7).orderBy(F.desc("doc_id")))]
    assert (models[0].weights == models[1].weights).all() and models[0].floor == models[1].floor


def test_awkward_rows(spark):
    """Null and empty texts, null ids, repeated rows, clashing names, contradicting labels, labels of other values."""
    docs = documents(spark).withColumnsRenamed({"fp": "__m", "row": "score", "id": "quality"})
    labels = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (7, 1), (8, 1), (13, 5), (15, 0), (16, None), (9, 1), (2, 0)], "doc_id long, quality int")
    drawn, sizes = P.sample(docs, labels)
    assert sizes == {0: 3, 1: 3}
    model = P.fit(drawn, sizes)
    got = docs.select("text", P.predict(model, docs).alias("s")).collect()
    assert len(got) == len(rows()) and len({(r["text"], r["s"]) for r in got}) == len({r["text"] for r in got})
    assert all(0 <= r["s"] <= 1 for r in got) and {r["s"] for r in got if not r["text"]} == {next(r["s"] for r in got if r["text"] == "")}


@pytest.mark.parametrize(("given", "score"), [([], 0.5), ([(5, 1), (7, 1)], 1.0), ([(5, 0)], 0.0)])
def test_without_pairs(spark, given, score):
    docs = documents(spark)
    model = P.fit(*P.sample(docs, spark.createDataFrame(given, "doc_id long, quality int")))
    assert {r[0] for r in docs.select(P.predict(model, docs)).collect()} == {score}
    empty = documents(spark, [])
    assert empty.select(P.predict(model, empty)).count() == 0


def test_sample_is_bounded(spark):
    """Also where one id has most of the rows."""
    docs = spark.range(4000).selectExpr("id doc_id", "'some text' text")
    hot = spark.range(5000).selectExpr("cast(0 as bigint) doc_id", "'hot' text").union(docs.filter("doc_id < 3"))
    seen = []
    P.Model, made = lambda m, *a: seen.append(len(m)), P.Model
    try:
        P.fit(*P.sample(hot, spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, quality int")))
    finally:
        P.Model = made
    assert seen == [3]
    drawn, sizes = P.sample(docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) quality"), per_class=200)
    n = {r["__good"]: r["count"] for r in drawn.groupBy("__good").count().collect()}
    assert sizes == {0: 3000, 1: 1000} and all(120 < n[k] < 280 for k in (0, 1))


def test_fit_is_the_minimum_of_the_pair_loss():
    r = np.random.default_rng(1)
    good, bad = r.normal(0.5, 1, (40, 3)), r.normal(-0.5, 1, (30, 3))
    w = P._fit(good, bad)

    def loss(v):
        n, m, total = 40, min(P.PARTNERS, 30), 0.0
        for k in range(m):
            d = good[np.arange(n) % 40] - bad[(np.arange(n) + k * (30 // m)) % 30]
            total += np.logaddexp(0, -(d @ v)).sum() / m
        return total + P.PULL / 2 * v @ v

    assert all(loss(w) <= loss(w + step) for step in 0.01 * r.normal(0, 1, (50, 3)))


def test_every_labelled_row_is_learned_from(spark):
    """Also where they are many more than any bound a draw would keep to."""
    docs = spark.range(20_000).selectExpr("id doc_id", "if(id % 4 = 0, 'Some good words, in a line.', '### 77 $$ ###') text")
    drawn, sizes = P.sample(docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) quality"))
    learned = P.Learned(drawn.selectExpr("doc_id __id", "__good", "cast(array_repeat(doc_id % 4, 18) as array<float>) m"))
    assert drawn.count() == len(learned) == 20_000 and sizes == {0: 15_000, 1: 5_000} and learned.sizes == (5_000, 15_000)
    pairs = learned.pairs(np.tile(np.arange(P.CUTS) / 4, (P.FEATURES, 1)), P.PARTNERS)
    assert pairs.count() == 15_000 * P.PARTNERS
    assert [r["count"] for r in pairs.groupBy("good").count().collect()] == [15_000 * P.PARTNERS]
    model = P.fit(drawn, sizes)
    assert {r[0]: r[1] > 0.3 for r in docs.select("text", P.predict(model, docs).alias("s")).distinct().collect()} == {"Some good words, in a line.": True, "### 77 $$ ###": False}


def test_pairs_are_those_of_rows_in_memory(spark):
    """The weights of stored pairs equal the weights of the same rows held in memory."""
    r = np.random.default_rng(5)
    for n_good, n_bad in ((40, 30), (9, 50)):
        m = r.integers(0, P.CUTS + 1, (n_good + n_bad, P.FEATURES)).astype(float)
        rows = [(k, int(k < n_good), x.tolist()) for k, x in enumerate(m)]
        learned = P.Learned(spark.createDataFrame(rows, "__id long, __good int, m array<float>"))
        cuts = np.tile(np.arange(P.CUTS) + 0.5, (P.FEATURES, 1))
        kept = sorted(learned.frame.collect(), key=lambda x: x["place"])
        good, bad = ((np.array([x["m"] for x in kept if x["__good"] == k])[:, :, None] > cuts[None]).reshape(-1, P.FEATURES * P.CUTS).astype(float) for k in (1, 0))
        pairs = learned.pairs(cuts, P.PARTNERS)
        got = P._newton(lambda w: P._spark_sums(pairs, w), P.FEATURES * P.CUTS, P.PARTNERS)
        assert np.allclose(got, P._fit(good, bad), atol=1e-9)
