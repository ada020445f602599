import random

import pytest

from watchloom.llm import simhash as S
from watchloom.llm.components import components

from .fixtures import documents, groups, rows, simhash, texts


def test_fingerprint_equals_brute_force():
    for t in [*texts()[:7], texts()[9], *texts()[17:]]:
        assert S.simhash(t) == simhash(t), (t or "")[:40]


def test_segments_cover_every_pair():
    r = random.Random(3)
    for radius in (1, 2, 3, 4, 5):
        for m in range(2, radius + 2):
            plan = S.segment_plan(m, radius)
            for _ in range(300):
                x = 0
                for b in r.sample(range(64), radius):
                    x |= 1 << b
                assert any((x & mask).bit_count() <= ball for mask, ball in plan)


def cloud(seed: int) -> list[int]:
    """Dense groups, chains of close and of far links, and loners."""
    r = random.Random(seed)
    out = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(6):
        x = r.getrandbits(64)
        out += [x] + [x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for _ in range(40)]
        for _ in range(15):
            for b in r.sample(range(64), 4):
                x ^= 1 << b
            out.append(x)
    return list(dict.fromkeys(out + [r.getrandbits(64) for _ in range(50)]))


@pytest.mark.parametrize("segments", [None, 2, 3, 5])
def test_groups_equal_brute_force(spark, segments):
    prints = cloud(segments or 1)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
    names = {r["fp"] % (1 << 64): r["name"] for r in S.component_names(df, 4, segments).collect()}
    assert [names[p] for p in prints] == groups(prints)


def test_documents_equal_brute_force(spark):
    given = [r for r in rows() if r[1] is None or len(r[1]) < 20_000]
    got = sorted(((r["id"], r["fp"], r["name"]) for r in S.near_duplicates(documents(spark, given)).collect()), key=repr)
    prints = [simhash(r[1]) for r in given]
    roots = groups(prints)
    names = {k: min((r[0] for r, x in zip(given, roots, strict=True) if x == k and r[0] is not None), default=None) for k in roots}
    want = [(r[0], p - (1 << 64) if p >> 63 else p, names[k]) for r, p, k in zip(given, prints, roots, strict=True)]
    assert got == sorted(want, key=repr)
    kept = S.keep_first(documents(spark, given))
    assert kept.columns == documents(spark, []).columns
    texts_kept = kept.collect()
    assert len(texts_kept) == len(set(roots))
    assert sorted(r["doc_id"] for r in texts_kept if r["doc_id"] is not None) == sorted(n for n in names.values() if n is not None)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert S.near_duplicates(empty).count() == 0 and S.keep_first(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(1, 5), (5, 1), (5, 5), (7, 1), (None, 3), (9, 8)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 5: 1, 7: 1, 8: 8, 9: 8, 500: 500, **{k: 500 for k in range(501, 540)}}
