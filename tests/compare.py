"""Run registered queries against their comparison SQL.

Usage: python -m tests.compare [name ...]   (default: every query)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else a description of the difference."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return "" if got else "no rows", len(got), t1 - t0
    cur = con.execute(sql)
    want_cols, want = table_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if t2 - t1 > 10:
        print(f"    (comparison SQL took {t2 - t1:.0f}s)")
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), t1 - t0
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), t1 - t0
    bad = {}
    for a, b in zip(got, want):
        for i, (x, y) in enumerate(zip(a, b)):
            if x != y:
                bad.setdefault(got_cols[i], []).append((x, y, a[:3]))
    if bad:
        text = "; ".join(f"{c}: {len(v)} e.g. {v[0]}" for c, v in list(bad.items())[:4])
        return f"{len(bad)} columns differ: {text}"[:1500], len(got), t1 - t0
    return "", len(got), t1 - t0


def main(names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    qs, sql = queries(), oracle_sql()
    failures = 0
    for name, fn in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            error, rows, sec = compare(spark, con, fn, sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            error, rows, sec = f"{type(e).__name__}: {str(e)[:1200]}", 0, 0.0
        failures += bool(error)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if error else 'ok  '} {name:32s} {kind} {rows:6d} rows {sec:6.1f}s {error}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
