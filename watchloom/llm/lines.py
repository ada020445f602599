"""Site-relative line frequency: drop lines that stand on too large a share of a site's pages.

Only DataFrame functions. Three steps: distinct (host, page, line) hashes are counted per host
and line; the lines over the ratio are gathered per host; each page is filtered against its
host's list. At most ``lines per page / ratio`` lines of a host can exceed the ratio (their
shares sum to the mean number of lines on a page), so the lists are bounded however large the
host, and a page's text is never taken apart into rows.

Defined results: a page is a distinct text of a host, so exact copies count once. Lines are
split at ``\\n`` and compared without ASCII spaces at their ends; blank lines are never counted or
dropped. A null text stays null and is no page; a text whose lines all go becomes empty; a
row without a host has no site and stays as it is. Lines and pages are compared by 64-bit hashes.
Repeated rows are treated alike, other columns pass through; ``__n_lines`` and ``__n_dropped`` replace
columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.binding import bound, restore, shield
from watchloom.session import materialize

#: A line goes if it stands on more than this share of its host's pages ...
RATIO = 0.05
#: ... and on a second page at all: a line of one page repeats nowhere, however small its host.
MIN_PAGES = 2
#: Column that tells, without counts, whether a row lost lines.
CUT = "__watchloom_lines_cut"
_SPACES = " \t\r\x0b\x0c"


def _line_hashes(text: Column) -> Column:
    """One hash per line, in order; null for a blank line."""
    key = lambda x: F.btrim(x, F.lit(_SPACES))
    return F.transform(F.split(text, "\n"), lambda x: F.when(key(x) != "", F.xxhash64(key(x))))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site``, ``bad``: the hashes of each host's boilerplate lines."""
    base = docs.select(docs[f"`{host}`"].alias("site"), docs[f"`{text}`"].cast("string").alias("t")).filter("site is not null and t is not null")
    # The page itself rides along as one more "line", so that one pass counts pages and lines.
    hashes = F.array_distinct(F.filter(_line_hashes(F.col("t")), lambda h: h.isNotNull()))
    tagged = F.concat(
        F.transform(hashes, lambda h: F.struct(F.lit(False).alias("whole"), h.alias("h"))),
        F.array(F.struct(F.lit(True).alias("whole"), F.lit(0).cast("long").alias("h"))),
    )
    seen = base.select("site", F.xxhash64("t").alias("page"), F.explode(tagged).alias("x")).select("site", "page", "x.*")
    n = seen.distinct().groupBy("site", "whole", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("whole") | (F.col("n") >= min_pages))
    n = materialize(n, "line-counts")
    pages = n.filter("whole").select("site", F.col("n").alias("pages"))
    over = n.filter("not whole").join(pages, "site").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("site").agg(F.sort_array(F.collect_list("h")).alias("bad"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``__n_lines``, ``__n_dropped``.

    Without ``counts`` all columns of ``docs`` stay, whatever their names, and ``CUT`` tells whether any line went.
    """
    bad = materialize(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    inner, at = shield(docs)
    body = at[text].cast("string")
    joined = inner.join(bad, at[host] == bad["site"], "left")
    # Few of a host's lines stand on one page: the page's own share of the list is looked through.
    marked = joined.withColumn("hits", F.coalesce(F.array_intersect(_line_hashes(body), "bad"), F.array().cast("array<long>")))
    key = lambda x: F.btrim(x, F.lit(_SPACES))
    stays = lambda hs: F.filter(F.split(body, "\n"), lambda x: (key(x) == "") | ~F.array_contains(hs, F.xxhash64(key(x))))
    some = F.size("hits") > 0
    cut = marked.withColumn("kept", F.when(some, bound(F.col("hits"), stays)))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(F.split(body, "\n")))
    dropped = F.when(some, n_lines - F.size("kept")).otherwise(0)
    told = {"__n_lines": n_lines, "__n_dropped": dropped} if counts else {CUT: dropped > 0}
    return restore(cut, at, **{text: F.when(some, F.array_join("kept", "\n")).otherwise(body)}, **told)


def op3_line_frequency(spark, sf_dir: str) -> DataFrame:
    """One row per document: lines, dropped lines and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_boilerplate(docs)
    return out.select(
        "doc_id",
        F.col("__n_lines").cast("long").alias("n_lines"),
        F.col("__n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )


OP3_SQL = rf"""
with l as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) line, unnest(generate_series(1, len(string_split(text, chr(10))))) k
  from documents where text is not null),
k as (select *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) as key from l),
pages as (select source, count(distinct text) pages from documents group by 1),
freq as (select source, key, count(distinct text) n from k where key <> '' group by 1, 2),
bad as (select source, key from freq join pages using (source) where n >= {MIN_PAGES} and n > {RATIO}::double * pages),
m as (select k.*, bad.key is not null as gone from k left join bad on k.source = bad.source and k.key = bad.key),
o as (select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
             coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') body from m group by 1)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped,
       case when d.text is not null then sha256(body) end text_sha256
from documents d left join o using (doc_id)
"""
