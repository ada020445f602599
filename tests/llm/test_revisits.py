import random

from pyspark.sql import functions as F

from watchloom.llm import revisits as R

SCHEMA = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers array<struct<name:string,value:string>>, found string, stored int, turn long"


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/?b=2&a=1&utm_source=x#top", "https://example.com:443/a?a=1&b=2", "HTTPS://user@www2.example.com/a///?a=1&&b=2&ref=q"]
    other = ["http://example.com/A?a=1&b=2", "http://example.com/a?a=1", "http://m.example.com/a?a=1&b=2", "", None]
    out = [r[0] for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(R.canonical_url(F.col("u"))).collect()]
    assert set(out[:3]) == {"example.com/a?a=1&b=2"} and len({*out}) == 6 and out[-2:] == ["", None]


def brute(records):
    def tag(x):
        x = None if x is None else x[2:] if x[:2] in ("W/", "w/") else x
        return x if x not in ("", '""') else None

    out = []
    for i, kind, url, ts, etag, modified, headers, *_ in records:
        if kind != "revisit":
            continue
        if None in (i, url, ts):
            out.append((i, None, "no_key"))
            continue
        full = [r for r in records if r[1] == "response" and r[2] == url and r[3] is not None and r[0] is not None and r[3] < ts]
        if not full:
            out.append((i, None, "no_response"))
            continue
        f = max(full, key=lambda r: (r[3], r[0]))
        a, b, c, d = tag(etag), tag(f[4]), (modified or "").strip() or None, (f[5] or "").strip() or None
        status = ("resolved" if a == b else "mismatch") if a and b else ("resolved" if c == d else "mismatch") if c and d else "unverified"
        out.append((i, None if status == "mismatch" else f[0], status))
    return sorted(out, key=repr)


def records(n=600, hot=True):
    r = random.Random(4)
    out = []
    for i in range(n):
        url = r.choice(["h.com/hot"] * (6 if hot else 1) + [f"h.com/{k}" for k in range(8)] + [None])
        headers = r.choice([None, [], [("ETag", "z"), ("Set-Cookie", "q")]])
        out.append((r.choice([i, i, i, i, None]), r.choice(["response", "revisit", "revisit", "request", None]), url, r.choice([None, *range(40)]), r.choice([None, "", '"a"', 'W/"a"', '"b"', '""']), r.choice([None, " ", "m1", "m2"]), headers, "f", 1, 2))
    return out + out[:50]


def test_equals_brute_force(spark):
    for given in (records(), records(80, False)):
        df = spark.createDataFrame(given, SCHEMA)
        got = sorted(((r["record_id"], r["response_id"], r["status"]) for r in R.resolve(df).collect()), key=repr)
        assert got == brute(given)


def test_one_key_spans_partitions(spark):
    given = [(i, "response" if i % 50 == 0 else "revisit", "h.com/x", i, '"t"', None, None, "f", 1, 2) for i in range(1000)]
    out = R.resolve(spark.createDataFrame(given, SCHEMA).repartition(7))
    assert {(r["record_id"], r["response_id"]) for r in out.collect()} == {(i, i - i % 50) for i in range(1000) if i % 50}


def test_only_permitted_headers_are_renewed(spark):
    given = [
        (1, "response", "h.com/", 1, '"t"', None, [("Content-Type", "text/html"), ("ETag", '"t"'), ("Vary", "a"), ("vary", "b"), ("Content-Length", "9")], "f", 1, 2),
        (2, "revisit", "h.com/", 2, 'W/"t"', None, [("content-length", "0"), ("VARY", "c"), ("Date", None), ("Set-Cookie", "x")], "f", 1, 2),
    ]
    row = R.resolve(spark.createDataFrame(given, SCHEMA)).first()
    assert [tuple(h) for h in row["headers"]] == [("Content-Type", "text/html"), ("ETag", '"t"'), ("Content-Length", "9"), ("VARY", "c"), ("Date", None)]


def test_empty_table(spark):
    assert R.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
