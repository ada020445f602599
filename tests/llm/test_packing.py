import random
import struct

import numpy as np
import pytest

from watchloom.llm import packing as K

from .fixtures import documents


def brute(widths, length):
    rows = []
    for k in sorted(range(len(widths)), key=lambda k: -widths[k]):
        room = lambda r: length - sum(widths[i] for i in r)
        fit = [r for r in rows if room(r) >= widths[k]]
        if fit:
            min(fit, key=room).append(k)
        else:
            rows.append([k])
    return rows


@pytest.mark.parametrize("length", [1, 7, 8, 100, 2048])
def test_best_fit_fills_like_brute_force(length):
    r = random.Random(length)
    for _ in range(20):
        widths = [r.randint(1, length) for _ in range(r.randrange(120))]
        mine, plain = K.best_fit(widths, length), brute(widths, length)
        assert sorted(k for row in mine for k in row) == list(range(len(widths)))
        fill = lambda rows: sorted(sorted(widths[k] for k in row) for row in rows)
        assert len(mine) == len(plain) and all(sum(widths[k] for k in row) <= length for row in mine)
        assert sorted(map(sum, fill(mine))) == sorted(map(sum, fill(plain)))


codes = lambda: lambda text: [ord(c) % 5000 for c in text]  # noqa: E731  a lambda travels by value


def unpacked(rows, length):
    parts = {}
    for r in rows:
        ids, at = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == len(at) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length and len(cu) == len(r["doc_ids"]) + 1
        for doc, part, a, b in zip(r["doc_ids"], r["parts"], cu, cu[1:], strict=False):
            parts.setdefault((doc, part), []).append(ids[a:b].tolist())
            assert at[a:b].tolist() == list(range(b - a))
        assert (ids[cu[-1] :] == 9).all()
    return parts


@pytest.mark.parametrize("group", [50, 100_000])
def test_nothing_is_lost(spark, group):
    docs = documents(spark)
    rows = K.pack(docs, codes, length=64, group=group, pad=9).collect()
    got = sum(len(x) for p in unpacked(rows, 64).values() for x in p)
    assert got == sum(len(r["text"] or "") for r in docs.collect())


def test_documents_are_rebuilt(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    parts = unpacked(K.pack(docs, codes, length=100, pad=9).collect(), 100)
    for r in docs.collect():
        mine = [parts[k][0] for k in sorted(k for k in parts if k[0] == r["doc_id"])]
        assert sum(mine, []) == codes()(r["text"] or "")
        assert all(len(x) == 100 for x in mine[:-1])


def test_matrices_hold_the_sequences(spark, tmp_path):
    packed = K.pack(documents(spark), codes, length=64, pad=9)
    K.write_matrices(packed, str(tmp_path / "m"), rows=8)
    out = spark.read.parquet(str(tmp_path / "m")).collect()
    rows = sorted(bytes(r["ids"]) for r in packed.collect())
    assert sorted(bytes(m["ids"][k * 128 : k * 128 + 128]) for m in out for k in range(m["n_rows"])) == rows
    for m in out:
        assert len(m["positions"]) == m["n_rows"] * 128 and sum(m["n_segments"]) == len(m["doc_ids"]) == len(m["cu_seqlens"]) - m["n_rows"]


def test_wide_ids_are_refused_or_wide(spark):
    docs = documents(spark, [(1, "x", "en", "s", 1, "x", None, 1, "r", "h", 1)])
    with pytest.raises(Exception, match="more than 16 bits"):
        K.pack(docs, lambda: lambda t: [70_000], pad=9).collect()
    row = K.pack(docs, lambda: lambda t: [70_000], length=4, pad=9, bits=32).first()
    assert struct.unpack("<4I", row["ids"]) == (70_000, 9, 9, 9)


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "date", "timestamp", "timestamp_ntz", "int", "boolean"])
def test_ids_keep_their_type(spark, tmp_path, kind):
    """Ids that are no numbers, numbers beyond a long, null ids; matrices hold them too."""
    value = {"string": "'a-1'", "decimal(20,0)": "99999999999999999999", "date": "'2024-02-29'", "timestamp": "'2024-02-29 01:02:03.000004'", "timestamp_ntz": "'2024-02-29 01:02:03.000004'", "int": "7", "boolean": "true"}[kind]
    docs = spark.sql(f"SELECT explode(array(CAST({value} AS {kind}), CAST(NULL AS {kind}))) AS doc_id, 'abc' AS text")
    packed = K.pack(docs, codes, length=4, pad=9)
    assert packed.schema["doc_ids"].dataType.simpleString() == f"array<{'bigint' if kind == 'int' else kind}>"
    want = sorted((r["doc_id"] for r in docs.collect()), key=repr)
    assert sorted((d for r in packed.collect() for d in r["doc_ids"]), key=repr) == want
    K.write_matrices(packed, str(tmp_path / "m"))
    assert sorted((d for m in spark.read.parquet(str(tmp_path / "m")).collect() for d in m["doc_ids"]), key=repr) == want


def test_empty_table(spark):
    assert K.pack(documents(spark, []), codes).count() == 0
