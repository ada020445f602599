from collections import Counter

from watchloom.llm import lines as L

from .fixtures import documents, rows


def brute(given, ratio, least):
    pages, on = {}, Counter()
    for r in given:
        if r[3] is not None and r[1] is not None:
            pages.setdefault(r[3], set()).add(r[1])
    for host, ps in pages.items():
        for p in ps:
            on.update({(host, x.strip(" \t\r\x0b\x0c")) for x in p.split("\n")} - {(host, "")})
    bad = {k for k, n in on.items() if n >= least and n > ratio * len(pages[k[0]])}
    return [None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" \t\r\x0b\x0c")) not in bad) for r in given]


def table(spark, given):
    return documents(spark, given)


def made():
    head = [(i, f"Menu\r\n\nbody {i}\n  About us  \nunique {i}", "en", "site", 1, "x", None, i, "r", "h", 1) for i in range(12)]
    copies = [(50 + i, "same page\nsame line", "en", "copies", 1, "x", None, i, "r", "h", 1) for i in range(20)]
    odd = [(90, None, "en", "site", 0, "x", None, 1, "r", "h", 1), (91, "", "en", "site", 0, "x", None, 1, "r", "h", 1), (92, "Menu", "en", None, 0, "x", None, 1, "r", "h", 1), (93, "Menu\nAbout us", "en", "site", 0, "x", None, 1, "r", "h", 1), (93, "Menu\nAbout us", "en", "site", 0, "x", None, 1, "r", "h", 1)]
    return head + copies + odd


def test_equals_brute_force(spark):
    for given, ratio, least in ((made(), 0.5, 5), (made(), 0.05, 2), (rows(), 0.05, 2), (made(), 0.05, 50)):
        out = L.drop_boilerplate(table(spark, given), ratio=ratio, min_pages=least)
        assert out.columns == [*table(spark, given).columns, "__n_lines", "__n_dropped"]
        got = sorted((repr(r["doc_id"]), repr(r["text"])) for r in out.collect())
        assert got == sorted((repr(r[0]), repr(t)) for r, t in zip(given, brute(given, ratio, least), strict=True))


def test_copies_of_a_page_are_one_page(spark):
    out = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(table(spark, made()), ratio=0.5).collect()}
    assert out[50] == "same page\nsame line" and out[92] == "Menu" and out[90] is None and out[93] == ""
    assert out[3] == "\nbody 3\nunique 3"


def test_empty_table(spark):
    assert L.drop_boilerplate(table(spark, [])).count() == 0
