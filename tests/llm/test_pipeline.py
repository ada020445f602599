import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as C
from tools.check import compare, connect
from watchloom.llm.queries import load_all

from .fixtures import contaminated, documents, groups, rows, simhash
from .test_quality import brute as counts_of

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in C.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.orderBy("doc_id").collect(), {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count()
        if name != "token ids":
            assert out.columns == docs.columns
        if name == "quality rules":
            assert all((r["doc_id"] in after) <= (counts_of(r["text"])[0] >= 50) for r in before)
        elif name == "line frequency":
            assert set(after) == {r["doc_id"] for r in before}
            assert all(r["n_chars"] == len(r["text"]) or r["text"] == next(b for b in before if b["doc_id"] == r["doc_id"])["text"] for r in after.values())
        elif name == "near duplicates":
            roots = groups([simhash(r["text"]) for r in before])
            assert set(after) == {before[k]["doc_id"] for k in set(roots)}
        elif name == "decontamination":
            assert set(after) == {r["doc_id"] for r in before if not contaminated(r["text"], items)[1]}
        else:
            assert set(after) == {r["doc_id"] for r in before}
            assert all(len(r["ids"]) == r["n_tokens"] for r in after.values())
        docs = out
    assert docs.count() > 50
    assert sorted(r["doc_id"] for r in C.run(spark, SMALL).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    for k, given in enumerate((rows(), [])):
        docs = documents(spark, given)
        for name, stage in C.STAGES:
            stage(spark, docs, SMALL).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
    assert docs.count() == 0


def test_repeated_rows_leave_one(spark):
    docs = documents(spark).filter(F.length("text") > 300)
    kept = C.near_duplicates(spark, docs.union(docs), SMALL)
    assert kept.groupBy("text").count().filter("count > 1").count() == 0


def test_clashing_columns_pass_the_line_stage(spark):
    docs = documents(spark).withColumnsRenamed({"fp": "__n_dropped", "row": "__n_lines"})
    out = C.line_frequency(spark, docs, SMALL)
    assert out.columns == docs.columns and {r["__n_lines"] for r in out.collect()} == {"r"}
