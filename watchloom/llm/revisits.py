"""WARC not-modified revisits: find the full response that a 304 record stands for.

Records are (``record_id``, ``kind`` 'response' or 'revisit', ``url``, ``ts``, ``etag``,
``last_modified``, ``headers`` as an array of name and value). A revisit takes the latest response
of the same canonical URL with an earlier ``ts``; of several at one time the greatest
``record_id``. Its validators are then checked and the headers that a 304 may renew are
merged into the stored ones. Payloads never move: the result names the response's record.

``status``: ``resolved`` (a validator agrees), ``unverified`` (no validator on both sides),
``mismatch`` (ETag, or without one Last-Modified, differs: the response isn't the revisited one, so
no ``response_id``), ``no_response`` (none earlier), ``no_key`` (null url, ts or record).

Defined results: one row per revisit, also for repeated ones; repeated responses count once; null
headers are none; names compare without case; a record of another kind is ignored; other
columns are dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.asof import last_before

#: Fixed value: what a 304 response sends to renew a stored response (RFC 9110, 15.4.5).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a visit and not a resource.
TRACKING = r"utm_[^=&]*|ref|sessionid"
_HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a closing slash, other parameters sorted.

    Scheme, user info and fragment don't tell resources apart.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^.*@|:(80|443)$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(f"^({TRACKING})(=|$)"))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    """Weak comparison: the tag without its ``W/``; null for an empty one."""
    return F.nullif(F.regexp_replace(etag, "^[Ww]/", ""), F.lit(""))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with each renewed header replaced by those of its name in ``fresh``, put last."""
    permitted = F.filter(fresh, lambda h: F.lower(h["name"]).isin(*RENEWED))
    names = F.transform(permitted, lambda h: F.lower(h["name"]))
    kept = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.concat(kept, permitted)


def resolve(records: DataFrame) -> DataFrame:
    """``record_id``, ``url_key``, ``ts``, ``response_id``, ``status``, ``headers`` of each revisit."""
    none = F.array().cast(_HEADERS)
    slim = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        "kind",
        canonical_url(F.col("url")).alias("url_key"),
        "ts",
        F.nullif(_opaque(F.col("etag")), F.lit('""')).alias("tag"),
        F.nullif(F.trim(F.col("last_modified").cast("string")), F.lit("")).alias("modified"),
        F.coalesce(F.col("headers").cast(_HEADERS), none).alias("headers"),
    )
    placeless = F.col("url_key").isNull() | F.col("ts").isNull() | F.col("record_id").isNull()
    # At one instant revisits come first: a response counts for later ones only.
    rows = slim.filter(~placeless).withColumns(
        {"turn": (F.col("kind") == "response").cast("int"), "stored": F.struct("record_id", "tag", "modified", "headers")}
    )
    seen = last_before(rows, ["url_key"], ["ts", "turn", "record_id"], F.col("kind") == "response", "stored").filter("kind = 'revisit'")
    both_tags = F.col("tag").isNotNull() & F.col("found.tag").isNotNull()
    both_times = F.col("modified").isNotNull() & F.col("found.modified").isNotNull()
    status = (
        F.when(F.col("found").isNull(), "no_response")
        .when(both_tags, F.when(F.col("tag") == F.col("found.tag"), "resolved").otherwise("mismatch"))
        .when(both_times, F.when(F.col("modified") == F.col("found.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    judged = seen.withColumn("status", status)
    usable = F.col("status").isin("resolved", "unverified")
    out = judged.select(
        "record_id",
        "url_key",
        "ts",
        F.when(usable, F.col("found.record_id")).alias("response_id"),
        "status",
        F.when(usable, merge_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    lost = slim.filter(placeless & (F.col("kind") == "revisit")).select("record_id", "url_key", "ts", F.lit(None).cast(out.schema["response_id"].dataType).alias("response_id"), F.lit("no_key").alias("status"), "headers")
    return out.unionByName(lost)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history of ``pages``: each page fetched in full once and asked for again three times."""
    at = F.lit(1_700_000_000).cast("long") + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    base = pages.select("page_id", "url", at.alias("at"), etag.alias("etag"), F.length("html").alias("size"))
    weak = F.concat(F.when(F.col("page_id") % 5 == 0, "W/").otherwise(""), F.col("etag"))
    no = F.lit(None).cast("string")
    fields = ("int", "string", "bigint", "string", "string")

    def case(*values) -> Column:
        return F.struct(*[v.cast(t).alias(n) for v, t, n in zip(values, fields, ("k", "kind", "ts", "tag", "modified"), strict=True)])

    late = F.when(F.col("page_id") % 3 != 0, F.col("at").cast("string")).when(F.col("page_id") % 2 == 0, (F.col("at") - 1).cast("string"))
    cases = F.array(
        case(F.lit(0), F.lit("response"), F.col("at"), F.col("etag"), F.col("at")),
        case(F.lit(1), F.lit("revisit"), F.col("at") + 86400, weak, no),
        case(F.lit(2), F.lit("revisit"), F.col("at") - 3600, F.col("etag"), no),
        case(F.lit(3), F.lit("revisit"), F.col("at") + 172800, no, late),
    )
    each = base.select("page_id", "url", "size", F.explode(cases).alias("c")).select("page_id", "url", "size", "c.*")
    full = F.array(header("Content-Type", F.lit("text/html")), header("ETag", F.col("tag")), header("Date", F.col("ts")), header("Content-Length", F.col("size")))
    short = F.array(header("date", F.col("ts")), header("Cache-Control", F.lit("max-age=60")), header("Content-Length", F.lit("0")), header("Set-Cookie", F.lit("a=1")))
    return each.select(
        (F.col("page_id") * 4 + F.col("k")).alias("record_id"), "kind", "url", "ts", F.col("tag").alias("etag"), F.col("modified").alias("last_modified"), F.when(F.col("k") == 0, full).otherwise(short).alias("headers")
    )


def op2_revisits(spark, sf_dir: str) -> DataFrame:
    """One row per revisit of the crawl history of ``pages``: its response and merged headers."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(":"), F.coalesce(h["value"], F.lit(""))))
    return found.select(
        "record_id", "url_key", "response_id", "status", F.size("headers").cast("long").alias("n_headers"), F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256")
    )


OP2_SQL = rf"""
with p as (
  select page_id, url, 1700000000 + page_id * 60 at_, '"' || substring(md5(html), 1, 16) || '"' etag, length(html) size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') rest
  from pages),
q as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@|:(80|443)$', '', 'g'), '^www\d*\.', '') host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^({TRACKING})(=|$)'))) args
  from p),
k as (select *, host || path || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end url_key from q),
resp as (select page_id * 4 response_id, url_key, at_ ts, etag, at_::varchar modified, size from k),
rev as (
  select page_id * 4 + 1 record_id, url_key, at_ + 86400 ts, etag, null modified from k
  union all select page_id * 4 + 2, url_key, at_ - 3600, etag, null from k
  union all select page_id * 4 + 3, url_key, at_ + 172800, null,
                   case when page_id % 3 <> 0 then at_::varchar when page_id % 2 = 0 then (at_ - 1)::varchar end from k),
near as (
  select rev.*, r.response_id rid, r.etag retag, r.modified rmod, r.size,  r.ts rts
  from rev left join resp r on r.url_key = rev.url_key and r.ts < rev.ts
  qualify row_number() over (partition by rev.record_id order by r.ts desc nulls last, r.response_id desc) = 1),
s as (
  select *, case when rid is null then 'no_response'
                 when etag is not null then case when etag = retag then 'resolved' else 'mismatch' end
                 when modified is not null then case when modified = rmod then 'resolved' else 'mismatch' end
                 else 'unverified' end status
  from near)
select record_id, url_key, case when status in ('resolved', 'unverified') then rid end response_id, status,
       case when status in ('resolved', 'unverified') then 5 else 4 end n_headers,
       sha256(case when status in ('resolved', 'unverified')
              then 'Content-Type:text/html' || chr(10) || 'ETag:' || retag || chr(10) || 'Content-Length:' || size || chr(10) || 'date:' || ts || chr(10) || 'Cache-Control:max-age=60'
              else 'date:' || ts || chr(10) || 'Cache-Control:max-age=60' || chr(10) || 'Content-Length:0' || chr(10) || 'Set-Cookie:a=1' end) headers_sha256
from s
"""
