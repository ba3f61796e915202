"""Run queries next to their SQL on DuckDB and compare rows."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differs(df, sql: str, sf_dir: str) -> str:
    """What is different, or an empty text."""
    names, want = oracle(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:3]}, only there {sorted(set(b) - set(a))[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__
    from tests.conftest import session

    spark, d = session(), sys.argv[1]
    sql, q = __spark_entry__.oracle_sql(), __spark_entry__.queries()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            out = differs(q[name](spark, d), sql[name], d) if name in sql else f"{q[name](spark, d).count()} rows"
        except Exception as e:
            out = f"failed: {str(e)[:400]}"
        print(f"{name}: {out or 'equal'} ({time.time() - t:.1f} s)", flush=True)
