import hashlib
import math

import numpy as np
import pytest

from watchloom.llm import pivots as P

SCHEMA = "vec_id long, embedding array<float>, label string, id int, v int, far string, place int"


def brute(given, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for i, e, lab, *_ in given if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    whole = sorted((r for r in kept if r[1] and len(r[1]) % parts == 0), key=order)
    if not whole:
        return {}, ""
    kept = [r for r in whole if len(r[1]) == len(whole[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = {}
    for i, v, _ in kept:
        seeds.setdefault(i, v)
    books = [[cut(v, p) for v in list(seeds.values())[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v, _ in kept:
                mine[assign(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)]
    rows = [(i, lab, [assign(v, p) for p in range(parts)]) for i, v, lab in kept]
    errors = {}
    for _, lab, a in rows:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in a)
    out = sorted((repr(i), "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), errors[lab]) for i, lab, a in rows)
    return out, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def made(seed=1, n=90, dimension=16, spread=1.0):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(r.normal(0, spread, dimension), 1)], [None, "a", "b"][i % 3]) for i in r.permutation(n)]
    same = [(200 + i, [0.25] * dimension, "hot") for i in range(40)]
    odd = [(300, None, "a"), (301, [], "a"), (302, [0.5] * (dimension - 1) + [None], None), (303, [float("nan")] * dimension, "b"), (304, [float("-inf")] + [0.0] * (dimension - 1), "b"), (305, [1.0] * 8, "c"), (306, [1.0] * 5, "c")]
    null_ids = [(None, [0.1] * dimension, "a"), (None, [-0.1] * dimension, None)]
    return rows + same + odd + null_ids + rows[:10] + [(rows[0][0], [9.0] * dimension, "z")]


def run(spark, given):
    df = spark.createDataFrame([(*r, 1, 2, "f", 3) for r in given], SCHEMA).repartition(3)
    codes, books = P.compress(df)
    got = sorted((repr(r["id"]), r["code"], r["error"], r["label_error"]) for r in codes.collect())
    return got, books.digest() if books else ""


@pytest.mark.parametrize("given", [made(), made(2, 7, 8), made(3, 60, 24, 100.0)])
def test_equals_full_search(spark, given):
    """Ties, copies, repeated ids, null ids and labels, fewer ids than entries, lengths that don't fit."""
    got, digest = run(spark, given)
    want, wanted = brute(given)
    assert got == want and digest == wanted


def test_without_vectors(spark):
    for given in ([], [(1, None, "a"), (2, [float("inf")] * 8, "a"), (3, [1.0] * 7, "a"), (4, [], None)]):
        assert run(spark, given) == ([], "")


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="can't be squared"):
        run(spark, [(1, [1e30] * 8, "a")])


def test_bounds_prune_and_never_change_a_result():
    r = np.random.default_rng(5)
    parts = np.concatenate([r.integers(-50, 50, (500, 8)) + c for c in r.integers(-4000, 4000, (16, 8))]).astype(np.int64)
    entries = parts[r.permutation(len(parts))[:16]]
    entries[3] = entries[11]  # a tie for every part
    pivots = P.choose_pivots(entries)
    code, best, evaluated = P.nearest(parts, P.to_pivots(parts[:, None], pivots[None])[:, 0], entries, pivots)
    full = P.squared(parts[:, None], entries[None])
    assert (code == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and 11 not in code
    assert evaluated < 0.5 * len(parts) * len(entries)


def test_squares_fit_a_long():
    for n in (8, 64, 72, 4096):
        assert 2**58 < n * (2 * P.limit(n)) ** 2 <= 2**63 - 1
