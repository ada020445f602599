"""Pattern tables against a plain loop."""

import random

from watchloom.operators import patterns as P


def plain(texts, patterns):
    return sorted({(k, p) for k, t in texts if t for p in patterns if p and p.lower() in t.lower()}, key=repr)


def scan(spark, texts, patterns):
    df = spark.createDataFrame(texts, "id long, body string")
    table = spark.createDataFrame([(p,) for p in patterns], "word string")
    return sorted((tuple(r) for r in P.pattern_table_scan(df, ["id"], "body", table, "word").collect()), key=repr)


def test_all_hits_over_block_ends(spark, monkeypatch):
    """Short, long, odd and repeated patterns; hits that lie over several blocks; null keys and texts."""
    monkeypatch.setattr(P, "BLOCK", 16)
    rnd = random.Random(3)
    texts = [(k, "".join(rnd.choice("abcAB \n😀é.") for _ in range(rnd.randrange(300)))) for k in range(60)]
    texts += [(None, "password in a text without a key"), (99, None), (98, ""), (97, "x" * 5000 + "Needle"), (5, "another row of key 5: zebra")]
    cuts = [t[i : i + n] for _, t in texts if t for n in (1, 2, 3, 4, 5, 9, 40) for i in [rnd.randrange(len(t))]]
    patterns = [*cuts, *cuts[:5], "PassWord", "password", "needle", "zebra", "absent", "(a.b", "\\d", "%", "", None, "x" * 5000 + "n"]
    assert scan(spark, texts, patterns) == plain(texts, patterns)


def test_a_hundred_thousand_patterns(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(4, 12))) for _ in range(100_000)]
    texts = [(k, " ".join(rnd.sample(words, 30))) for k in range(20)]
    lows = set(words)
    want = sorted({(k, t[i:j]) for k, t in texts for i in range(len(t)) for j in range(i + 4, min(i + 12, len(t)) + 1) if t[i:j] in lows}, key=repr)
    assert scan(spark, texts, words) == want


def test_empty_tables(spark):
    assert scan(spark, [], ["a"]) == [] and scan(spark, [(1, "a")], []) == [] and scan(spark, [(1, "a")], ["", None]) == []


def test_texts_are_not_dealt_out(spark):
    """Finds of rows of distinct keys come without a shuffle; those of repeated keys are made distinct."""
    table = spark.createDataFrame([("some Words",), ("some words",), ("words",), ("absent",)], "word string")
    out = P.pattern_table_scan(spark.range(50).selectExpr("id", "'There are some words in it' body"), ["id"], "body", table, "word")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 150
    assert scan(spark, [(1, "some words"), (1, "SOME WORDS"), (None, "words"), (None, "words"), (2, "words")], ["words", "some words"]) == plain([(1, "some words"), (None, "words"), (2, "words")], ["words", "some words"])


def test_slices_of_patterns(spark, monkeypatch):
    """A pattern table over the size of a broadcast is looked for slice by slice."""
    texts = [(k, f"word{k} and word{k + 1}, then é{k}漢字 and more") for k in range(30)]
    patterns = [f"word{k}" for k in range(40)] + [f"é{k}漢字" for k in range(40)] + ["and word", "a"]
    monkeypatch.setattr(P, "SLICE", 200)
    assert scan(spark, texts, patterns) == plain(texts, patterns)
