"""Compare registered queries with their SQL twins on the same parquet tables.

As a script: ``python tests/oracle.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, sf, name, fn, sql, con):
    """None if equal, else a description of the difference."""
    df = fn(spark, sf)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:3]} | {want[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tidepool.session import get_session
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, sf, name, fn, sql[name], con)
            else:
                rows = fn(spark, sf).collect()
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s "
              f"{'sql ' if name in sql else 'rows'} {name} {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
