"""Compare every registered query with its SQL in DuckDB.

    python -m tests.oracle [sf_dir] [key ...]
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from placewatch.catalog.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    """One value in a form both engines share."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}" if not v.is_integer() or abs(v) > 1e15 else str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def bag(names: list[str], rows) -> collections.Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, df.collect()
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = bag(got_names, got), bag(want_names, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} vs {len(want)}; {sum((a - b).values())} differ\n   spark {only_a}\n   sql   {only_b}"
    return None if got else "no rows"


def main() -> int:
    from placewatch.catalog import ORACLES, QUERIES
    from placewatch.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [k for k in QUERIES if not args or any(k == a or k.startswith(a.rstrip("*")) and a.endswith("*") for a in args)]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for k in keys:
        at = time.time()
        try:
            if k in ORACLES:
                out = compare(spark, con, QUERIES[k], ORACLES[k], sf_dir)
            else:
                n = QUERIES[k](spark, sf_dir).count()
                out = None if n else "no rows"
        except Exception as e:  # report and go on
            out = f"{type(e).__name__}: {str(e)[:900]}"
        bad += out is not None
        note = "" if k in ORACLES else " (rows only)"
        print(f"{'ok  ' if out is None else 'FAIL'} {k}{note} {time.time() - at:.1f}s" + (f"\n   {out}" if out else ""), flush=True)
    print(f"{len(keys) - bad} of {len(keys)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
