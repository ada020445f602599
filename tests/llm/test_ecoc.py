import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from watchloom.llm import ecoc as E

from .fixtures import documents


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20, 100])
def test_codewords_are_far_apart(n):
    code = E.codebook(n).astype(int)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n < 3 else 2 if n == 3 else code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_wrong_bits_are_corrected():
    model = E.Model(["a", "b", "c", "d"], np.ones((4, 8)))
    for k in range(4):
        for bit in range(model.code.shape[1]):
            margins = model.code[k].astype(float)
            margins[bit] *= -1
            assert model.losses(margins).argmin() == k


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = E.op5_language_codes(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, low, high = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.95 and 0 <= low and high <= 1


def test_learning_ignores_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = E.held_out("doc_id")
    plain = E.fit(E.sample(docs.filter(~held), "doc_id", "lang"))
    wrong = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(held, "zzz").otherwise(F.col("text")))
    other = E.fit(E.sample(wrong.filter(~held), "doc_id", "lang"))
    assert plain.langs == other.langs and np.array_equal(plain.weights, other.weights) and np.array_equal(plain.trust, other.trust)


def test_sample_is_bounded_and_every_language_is_in(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("lang"))
    got = dict(map(tuple, E.sample(docs, "doc_id", "lang", 300).groupBy("lang").count().collect()))
    assert got["rare"] == 200 and 200 < got["hot"] < 400


def test_awkward_rows(spark):
    docs = documents(spark)
    model = E.fit(docs.filter("lang is not null"))
    out = docs.select("text", E.predict(model, docs).alias("p")).select("text", "p.*").collect()
    assert len(out) == docs.count()
    for r in out:
        none = not r["text"] or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (r["score"] == 0) == none
    for given, want in ((docs.limit(0), "und"), (docs.filter("lang = 'en'"), "en")):
        few = E.fit(given)
        assert docs.filter("length(text) > 300").select(E.predict(few, docs)["lang_pred"]).first()[0] == want
    empty = documents(spark, [])
    assert empty.select(E.predict(model, empty)).count() == 0
