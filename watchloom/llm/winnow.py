"""Benchmark decontamination by winnowing.

Only DataFrame functions. A text's fingerprints are the smallest hash in each window of
``WINDOW - GRAM + 1`` consecutive word ``GRAM``-grams, so any shared run of ``WINDOW`` words has a
fingerprint in common. Fingerprints of documents, each with the few words around it, meet
those of the benchmark in an equi-join; hits are extended to the word windows that cover them, and these
are compared in full. Texts are read once and never shuffled.
An item shorter than the window is one window of its own length, met by the hash of that many words.

Words, not row numbers, decide, so results are found per distinct text (by its SHA-256) and
joined back to rows: repeated rows, copies and null ids need no care.

Defined results: a null, empty or wordless text has no words, no hits and is clean; a null,
empty or wordless item never occurs; items with the same words all count, repeated
``item_id`` rows once, an item without an id counts as an item but isn't named in the digest; an
empty benchmark leaves every document clean. Other columns of the inputs don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.binding import bound, restore, shield
from watchloom.llm.sieve import without
from watchloom.session import materialize, materialize_counted

#: A shared run of this many words is contamination.
WINDOW = 10
#: Words per hashed gram.
GRAM = 6
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longer texts and items are looked through in blocks of so many words, which bounds what a row holds.
BLOCK = 1 << 16
_PLACES = (1 << 17) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; an empty array for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lower, _SEPARATORS), ""), F.array().cast("array<string>"))


def _gram_hashes(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, from one hash per word."""
    runs = lambda each: F.transform(F.sequence(F.lit(0), F.size(each) - size), lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(size)]))
    hashes = bound(F.transform(words, lambda w: F.xxhash64(w)), runs)
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<long>"))


def _minima(hashes: Column, span: int) -> Column:
    """The smallest hash in every ``span`` consecutive ones, the last of equals, each place once.

    Hash and place share a long: 46 bits of the hash above, the place counted down in the 17
    bits below, so that one comparison settles both. Places of minima never go back, so only
    neighbours can repeat.
    """
    packed = lambda hs: F.transform(hs, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 18), 17).bitwiseOR(F.lit(_PLACES) - i))
    least = lambda ps: F.transform(F.sequence(F.lit(0), F.size(ps) - span), lambda i: F.least(*[F.get(ps, i + k) for k in range(span)]) if span > 1 else F.get(ps, i))
    once = lambda ms: F.filter(ms, lambda m, i: (i == 0) | (m != F.get(ms, i - 1)))
    none = F.array().cast("array<long>")
    return bound(bound(hashes, packed), lambda ps: F.when(F.size(ps) >= span, bound(least(ps), once)).otherwise(none))


def _hash_of(mark: Column) -> Column:
    return F.shiftright(mark, 17)


def _place_of(mark: Column) -> Column:
    return (F.lit(_PLACES) - mark.bitwiseAND(F.lit(_PLACES))).cast("int")


def _blocks(words: Column, window: int) -> Column:
    """The words in blocks of bounded length: every run of ``window`` words lies inside one."""
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)), F.lit(BLOCK))
    return bound(words, lambda w: F.transform(starts(w), lambda b: F.struct(b.alias("base"), F.slice(w, b + 1, BLOCK + window - 1).alias("w"))))


def _gram(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Tables of the benchmark: (``gram``, ``size``, ``item``), a row per item of a gram, and the items' words."""
    words = materialize(items.select(items[f"`{item_id}`"].alias("item"), words_of(items[f"`{text}`"].cast("string")).alias("w")).filter(F.size("w") > 0), "items")
    size = F.least(F.size("w"), F.lit(window))
    cut = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("s"))
    grams = cut.select("item", "size", _gram(F.col("w"), F.col("s"), F.col("size")).alias("gram")).distinct()
    return materialize(grams, "grams"), words


def _targets(words: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """Hashes to look for with their run length, and the lengths under ``window`` (at most ``window - 1``)."""
    blocks = words.filter(F.size("w") >= window).select(F.explode(_blocks(F.col("w"), window)).alias("b")).select("b.w")
    long_items = blocks.select(F.explode(_minima(_gram_hashes(F.col("w"), gram), window - gram + 1)).alias("x")).select(F.lit(gram).alias("size"), _hash_of(F.col("x")).alias("h"), F.lit(True).alias("winnowed"))
    lengths = sorted(r[0] for r in words.filter(F.size("w") < window).select(F.size("w")).distinct().collect())
    found = long_items
    for m in lengths:
        found = found.union(words.filter(F.size("w") == m).select(F.lit(m), F.element_at(_gram_hashes(F.col("w"), m), 1), F.lit(False)))
    return materialize(found.distinct(), "targets"), lengths


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, named: bool = True) -> DataFrame:
    """Per distinct contaminated text: ``key`` (SHA-256), ``n_hit`` and, if ``named``, ``n_items``, ``items`` (sorted strings)."""
    grams, item_words = item_windows(items, item_id, item_text, window)
    targets, lengths = _targets(item_words, window, gram)
    body = docs.select(docs[f"`{text}`"].cast("string").alias("t")).filter("t is not null")
    split = body.select(F.sha2("t", 256).alias("key"), F.explode(_blocks(words_of(F.col("t")), window)).alias("b")).select("key", "b.*").filter(F.size("w") > 0)

    # A fingerprint takes along the words around it: all windows that cover its gram.
    side = window - gram

    def around(w, mark):
        first = F.greatest(_place_of(mark) - side, F.lit(0))
        return F.struct(_hash_of(mark).alias("h"), first.alias("s"), _gram(w, first, F.lit(side + window) - F.greatest(F.lit(side) - _place_of(mark), F.lit(0))).alias("near"))

    marks = F.transform(_minima(_gram_hashes(F.col("w"), gram), side + 1), lambda m: around(F.col("w"), m))
    wanted = targets.select("h", "size", "winnowed")
    seen = split.select("key", "base", F.explode(marks).alias("x")).select("key", "x.h", (F.col("base") + F.col("x.s")).alias("s"), "x.near")
    hits = seen.join(wanted.filter("winnowed"), "h", "left_semi").select("key", "s", F.split("near", " ").alias("near"), F.lit(window).alias("size"))
    for m in lengths:
        runs = F.transform(_gram_hashes(F.col("w"), m), _run_of(m))
        found = split.select("key", "base", F.explode(runs).alias("x")).select("key", "x.h", (F.col("base") + F.col("x.s")).alias("s"), "x.near")
        short = found.join(wanted.filter((F.col("size") == m) & ~F.col("winnowed")), "h", "left_semi")
        hits = hits.union(short.select("key", "s", F.split("near", " "), F.lit(m)))

    windows = F.transform(
        F.sequence(F.lit(0), F.size("near") - F.col("size")),
        lambda i: F.struct((F.col("s") + i).alias("s"), _gram(F.col("near"), i, F.col("size")).alias("gram")),
    )
    some = F.when(F.size("near") >= F.col("size"), windows)
    cut = hits.select("key", "size", F.explode(some).alias("x")).select("key", "size", "x.*")
    # Items come last: a gram that many items share is one row here, whatever it hits.
    met = materialize(cut.join(grams.select("gram", "size").distinct(), ["gram", "size"]), "met")
    runs = met.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("s", "size"))).alias("runs"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["s"] + x["size"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["s"] + x["size"]).alias("end")),
        lambda a: a["n"],
    )
    places = runs.select("key", covered.cast("long").alias("n_hit"))
    if not named:
        return places
    # Texts that hold the same grams meet the same items; an item without an id is one row like any other.
    items_met = met.select("key", "gram", "size").distinct().join(grams, ["gram", "size"]).select("key", "item").distinct()
    names = items_met.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    return places.join(names, "key")


def _run_of(size: int):
    return lambda h, i: F.struct(h.alias("h"), i.alias("s"), _gram(F.col("w"), i, F.lit(size)).alias("near"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, unchanged."""
    dirty, n, _ = materialize_counted(contamination(docs, items, text, named=False).select("key"), "contaminated")
    inner, at = shield(docs)
    return restore(without(inner, F.sha2(at[text].cast("string"), 256), dirty, n), at)


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    """One row per document: words, words inside benchmark windows, the items met."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = materialize(contamination(docs, items), "contaminated")
    every = docs.select("doc_id", F.sha2("text", 256).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = rf"""
with dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SEPARATORS}'), lambda x: x <> '') w from documents),
iw as (
  select item_id, w, least(len(w), {WINDOW}) m
  from (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SEPARATORS}'), lambda x: x <> '') w from benchmark)
  where len(w) > 0),
ig as (
  select distinct item_id, m, list_aggregate(w[s : s + m - 1], 'string_agg', ' ') gram
  from (select item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) s from iw)),
lengths as (select distinct m from iw),
dg as (
  select doc_id, s, m, list_aggregate(w[s : s + m - 1], 'string_agg', ' ') gram
  from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) s from dw, lengths where len(w) >= m)),
hit as (select doc_id, s, ig.m, item_id from dg join ig on dg.m = ig.m and dg.gram = ig.gram),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(s, s + m - 1)) p from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) names from (select distinct doc_id, item_id::varchar i from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (doc_id) left join its using (doc_id)
"""
