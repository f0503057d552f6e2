"""Compare every registered query with its SQL on one folder of driver tables.

Run ``python tests/compare.py [folder] [name ...]``; pytest uses the same functions.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if hasattr(value, "quantize"):
        return round(float(value), 9) + 0.0
    if isinstance(value, bool):
        return value
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, query, sql: str, folder: str, need_rows: bool = True) -> str | None:
    """None when both sides agree, else a short description of the difference."""
    df = query(spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = table(names, res.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    if need_rows and not mine[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(mine[1])} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from attestra.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            why = compare(spark, con, queries[name], oracles[name], folder) if name in oracles else "no oracle"
        except Exception as error:
            why = f"{type(error).__name__}: {str(error)[:600]}"
        failed += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {name} {time.time() - start:.1f}s {why or ''}", flush=True)
    print(f"{failed} failed")
