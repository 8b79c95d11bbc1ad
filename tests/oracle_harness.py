"""Compare the named queries with their DuckDB oracles.

Run ``python tests/oracle_harness.py [sf_dir] [name …]`` for a report.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (int, str, bytes)):
        return x
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return str(x)


def key(row):
    return repr(row)


def compare(con, spark, sf_dir: str, run, sql: str | None):
    """→ (n_rows, error text or None)."""
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return len(got), f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=key)
    if got == want and [type(x) for r in got[:50] for x in r] == [type(x) for r in want[:50] for x in r]:
        return len(got), None
    text = f"rows {len(got)} vs {len(want)}"
    a, b = {key(r) for r in got}, {key(r) for r in want}
    only_got, only_want = sorted(a - b), sorted(b - a)
    return len(got), f"{text}; {cols}; spark only {len(only_got)}: {only_got[:2]}; duckdb only {len(only_want)}: {only_want[:2]}"


def main(argv):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry

    from feedweir.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", "oracle", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            n, error = compare(con, spark, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # report and go on
            n, error = -1, f"{type(e).__name__}: {e}"[:1500]
            if "database has been invalidated" in error or "INTERNAL" in error:
                con = connect(sf_dir)
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if error is None else 'BAD'} {name} {kind} rows={n} {time.time() - start:.1f}s", flush=True)
        if error:
            bad += 1
            print("    ", error[:1800], flush=True)
    print("queries", len(names or queries), "bad", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
