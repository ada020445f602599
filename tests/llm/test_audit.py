import re
from itertools import permutations

import pytest

from watchloom.llm import audit as A

from .fixtures import documents, rows

LABELS = [(None, 1, 1), (1, 1, 0), (1, 0, 1), (7, 0, 1), (9, 1, None), (10, None, None), (16, 1, 1), (17, 0, 0), (999, 1, 1)]


def brute(given, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1} - {None}, {r[0] for r in labels if r[2] == 1} - {None}
    smallest, out = {}, {}
    for r in given:
        if r[0] is not None:
            smallest[r[1] or ""] = min(smallest.get(r[1] or "", r[0]), r[0])
    parts = {}
    for r in given:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = smallest.get(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and first is not None and r[0] > first}
        parts.setdefault(r[3] or "", []).append(({k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, order, step + 1] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


@pytest.mark.parametrize("given", [rows(), rows() + [(40 + i, "SAME & same " * 150, "en", "a", 1, "x", None, i, "r", "h", 1) for i in range(60)]])
def test_equals_filtering_in_every_order(spark, given):
    """Null ids, texts and parts, repeated rows, many copies, labels that repeat or contradict, clashing names."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = documents(spark, given).withColumnsRenamed({"fp": "digest", "row": "cell", "id": "part", "kept": "first"})
    out = A.audit(A.cells(docs.repartition(5), labels))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = out.collect()
    got = {tuple(r[:3]): list(r[3:]) for r in found}
    assert len(found) == len(got) == 3 * 600 and got == brute(given, LABELS)


def test_shapley_shares_add_up(spark):
    out = A.audit(A.cells(documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).filter("filter_order = 'ABCDE'").collect()
    for part in {r["part"] for r in out}:
        own = [r for r in out if r["part"] == part]
        assert sum(r["shapley"] for r in own) == 120 * sum(r["removed"] for r in own)
        assert not any(r["good_lost"] or r["toxic_lost"] for r in own)


def test_empty_table(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert A.audit(A.cells(documents(spark, []), labels)).count() == 0


def test_texts_are_not_shuffled(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = A.cells(spark.read.parquet(str(tmp_path / "d")), labels)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
