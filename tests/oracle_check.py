"""Compare registered queries with their DuckDB SQL, value for value.

usage: python tests/oracle_check.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DUCK_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_by_name(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types, row counts and all values agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    expected = rel.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    for name, kind in df.dtypes:
        if DUCK_TYPES.get(kind, kind) != kinds[name]:
            out.append(f"type {name}: {kind} vs {kinds[name]}")
    got = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    want = rows_by_name(names, expected)
    if len(got) != len(want):
        out.append(f"rows {len(got)} vs {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        out.append(f"{len(bad)} differing rows, first:\n   {bad[0][0]}\n   {bad[0][1]}")
    if not want:
        out.append("no rows")
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry
    from faultloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, sqls = local_session(8), duck(sf_dir), entry.oracle_sql()
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sqls:
                diff = differences(df, con, sqls[name])
            else:
                diff = [] if df.count() else ["no rows"]
        except Exception as e:  # report and go on with the next query
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t0:.1f}s", *diff, sep="\n  " if diff else " ", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
