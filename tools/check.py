"""Compare registered queries with their oracle SQL: python tools/check.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple((type(r[i]).__name__, r[i] if not isinstance(r[i], float) else round(r[i], 9)) for i in order))
    return sorted(out, key=repr)


def compare(df, con, sql):
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(ocols):
        return f"columns differ: {sorted(cols)} vs {sorted(ocols)}"
    if len(got) != len(want):
        return f"row counts differ: {len(got)} vs {len(want)}"
    a, b = canon(got, cols), canon(want, ocols)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, cols {sorted(cols)}, first: {bad[0][0]} vs {bad[0][1]}"
    return None


def main():
    from watchloom.plans import load_all
    from watchloom.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "sf0.01"
    queries, oracles = load_all()
    names = args[1:] or list(queries)
    if len(args) > 1 and args[1].startswith("@"):
        names = [n for n, f in queries.items() if f.__module__.endswith("." + args[1][1:])]
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    spark = build_session("check", 8, 8)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in oracles:
                msg = compare(df, con, oracles[n])
                kind = "ok"
            else:
                msg, kind = None, f"rows-only {df.count()}"
            if not msg and n in oracles:
                kind += f" rows={df.count()}" if os.environ.get("COUNT") else ""
        except Exception as e:
            msg, kind = (traceback.format_exc()[-1500:] if os.environ.get("TRACE") else str(e)[:1200]), ""
        print(f"{'FAIL' if msg else kind:14s} {n:24s} {time.time() - t:6.2f}s {msg or ''}", flush=True)
        if msg:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
