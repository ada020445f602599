import pytest

from watchloom.llm import sieve


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_without_equals_an_anti_join(spark, monkeypatch, bits):
    """Also when nearly every bit is set and when there are many pages."""
    monkeypatch.setattr(sieve, "MOST_BITS", bits)
    rows = [(str(i % 7000) if i % 11 else None, i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v int")
    keys = [(str(i),) for i in range(0, 6000, 3)] + [(None,), ("3",)]
    for listed in (keys, keys[:1], []):
        out = sieve.without(df, df["k"], spark.createDataFrame(listed, "key string"), len(listed))
        bad = {k for (k,) in listed if k is not None}
        assert sorted(r["v"] for r in out.collect()) == [v for k, v in rows if k not in bad]
        assert out.columns == ["k", "v"]


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat('x', 100) t").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = sieve.without(df, df["id"], spark.range(10), 10)._jdf.queryExecution().executedPlan().toString()
    sure = plan.split("Union")[1].split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" in sure and plan.count("Exchange hashpartitioning(__key") == 1
