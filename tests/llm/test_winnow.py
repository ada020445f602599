import random

from pyspark.sql import functions as F

from watchloom.llm import winnow as W

from .fixtures import contaminated, documents, prose, rows

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (1, "one two three four five six seven eight nine ten eleven twelve"), (None, "a b a b a b a b a b a b"), (3, "Short One"), (4, None), (5, " .!? "), (6, "ÉCOLE école x" * 4), (70, "w w w w w w w w w w w"), (8, "p q r s t u v w x")]


def given():
    r = random.Random(5)
    alphabet = "a b one two three w x short école p q".split()
    out = rows()
    for i in range(150):
        words = [r.choice(alphabet) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            body = (r.choice(ITEMS)[1] or "").split()
            a = r.randrange(len(body) + 1)
            at = r.randrange(len(words) + 1)
            words[at:at] = body[a : a + r.randrange(3, 14)]
        sep = r.choice([" ", "\n", ", ", "--"])
        out.append((i, sep.join(w.upper() if r.random() < 0.2 else w for w in words), "en", "s", 1, "x", None, i, "r", "h", 1))
    return out


def test_equals_brute_force(spark):
    docs = given()
    items = spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, key string")
    found = {r["key"]: r for r in W.contamination(documents(spark, docs), items).withColumn("items", F.col("items")).collect()}
    for r, d in zip(docs, documents(spark, docs).select(F.sha2("text", 256)).collect(), strict=True):
        n, hit, met, names = contaminated(r[1], ITEMS)
        got = found.get(d[0])
        assert (got and (got["n_hit"], got["n_items"], got["items"])) == ((hit, met, names) if hit else None), r[1]
    kept = W.keep_clean(documents(spark, docs), items)
    assert kept.columns == documents(spark, docs).columns
    assert sorted(map(repr, (x["text"] for x in kept.collect()))) == sorted(repr(r[1]) for r in docs if not contaminated(r[1], ITEMS)[1])


def test_blocks_of_a_long_text_lose_nothing(spark, monkeypatch):
    docs = documents(spark, given())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, W.contamination(docs, items).collect()))
    for block in (1, 7, 16):
        monkeypatch.setattr(W, "BLOCK", block)
        assert sorted(map(tuple, W.contamination(docs, items).collect())) == want


def passages(spark, item: str, places: list[int]):
    """Documents that each hold twelve words of the item, and what looking everywhere finds."""
    words = item.split()
    docs = [(k, " ".join(["before", *words[p : p + 12], "after"]), "en", "s", 1, "x", None, k, "r", "h", 1) for k, p in enumerate(places)]
    return documents(spark, docs)


def test_blocks_of_a_long_item_lose_nothing(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(300))
    docs = passages(spark, item, list(range(0, 288, 7)))
    monkeypatch.setattr(W, "BLOCK", 16)
    monkeypatch.setattr(W, "_PLACES", 31)
    items = spark.createDataFrame([(1, item), (2, "w250 w251 other words")], "item_id long, text string")
    found = {r["key"]: (r["n_hit"], r["n_items"], r["items"]) for r in W.contamination(docs, items).collect()}
    for r in docs.select("text", F.sha2("text", 256).alias("key")).collect():
        assert found[r["key"]] == contaminated(r["text"], [(1, item), (2, "w250 w251 other words")])[1:]


def test_passages_far_inside_an_item_are_met(spark):
    item = prose(77, 140_000)
    places = [5, 65_530, 131_050, 131_066, 131_080, 135_000, 139_980]
    found = W.contamination(passages(spark, item, places), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r["n_hit"] for r in found.collect()] == [12] * len(places)


def test_any_gram_length_gives_the_same(spark):
    docs = documents(spark, given())
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(map(tuple, W.contamination(docs, items).collect()))
    for gram in (1, 4, 10):
        assert sorted(map(tuple, W.contamination(docs, items, gram=gram).collect())) == want


def test_empty_tables(spark):
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert W.contamination(docs, items.limit(0)).count() == 0
    assert W.contamination(documents(spark, []), items).count() == 0
    assert W.keep_clean(docs, items.limit(0)).count() == docs.count()
