import re

from watchloom.llm import quality as Q

from .fixtures import documents, texts


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    repeated = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force():
    for t in [*texts(), "a b a b a b", "x x x x", "#*$%&|<> a", "a\nb\na\n \n \n", "a b c\x1cd"]:
        assert Q.text_counts(t)[:5] == brute(t), (t or "")[:40]


def test_wide_ids_do_not_overflow():
    import numpy as np

    ids = np.arange(3_000_000)
    assert Q.repeated_positions(np.concatenate([ids, [5, 6, 7]])) == 6


def test_ledger_keeps_every_row_and_policies_are_masks(spark):
    docs = documents(spark)
    judged = Q.ledger(docs)
    out = judged.collect()
    assert len(out) == docs.count() and set(docs.columns) - set(judged.columns) == set()
    for r in out:
        failed = {x.name for i, x in enumerate(Q.RULES) if r["fail_mask"] >> i & 1}
        assert ("too_few_words" in failed) == (r["n_words"] < 50)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["fail_mask"] & Q.CURRENT.mask() == 0 for r in out)
    assert all(r["n_words"] == "x" for r in kept.collect())


def test_ablation_equals_recount(spark):
    judged = Q.ledger(documents(spark)).cache()
    masks = [r["fail_mask"] for r in judged.collect()]
    for r in Q.ablation(judged, [Q.BASE, Q.STRICT, Q.CURRENT]).collect():
        policy = next(p for p in (Q.BASE, Q.STRICT, Q.CURRENT) if (p.name, p.version) == (r["policy"], r["version"]))
        bit = Q.Policy("", 0, (r["rule"],)).mask()
        assert r["n_failing"] == sum(m & bit != 0 for m in masks)
        assert r["n_sole"] == sum(m & policy.mask() == bit for m in masks)
        assert r["n_kept"] == sum(m & policy.mask() == 0 for m in masks)
        assert r["n_kept_without"] == sum(m & (policy.mask() & ~bit) == 0 for m in masks)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert Q.ledger(empty).count() == 0 and Q.keep_good(empty).count() == 0
