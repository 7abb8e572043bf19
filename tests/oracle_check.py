"""Runs registered queries against their DuckDB counterparts: python tests/oracle_check.py <sf_dir> [query ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.9e}")
    return (2, str(value))


def _same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) and not exact:
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def compare(spark, con, query, sql: str, sf_dir: str, exact: bool = True) -> list[str]:
    """Differences between both results; empty when rows, columns, types and values agree."""
    left = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(left.columns) != sorted(names):
        return [f"columns {sorted(left.columns)} != {sorted(names)}"]
    order = sorted(names)
    rows_a = sorted((tuple(r[c] for c in order) for r in left.collect()), key=lambda r: [_key(v) for v in r])
    at = [names.index(c) for c in order]
    rows_b = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=lambda r: [_key(v) for v in r])
    if len(rows_a) != len(rows_b):
        return [f"rows {len(rows_a)} != {len(rows_b)}", f"first spark {rows_a[:1]}", f"first duckdb {rows_b[:1]}"]
    bad = [(a, b) for a, b in zip(rows_a, rows_b) if not all(_same(x, y, exact) for x, y in zip(a, b))]
    return [f"{len(bad)} rows differ", f"{order}", *[f"{a}\n   {b}" for a, b in bad[:2]]] if bad else []


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from ledgermill.session import local_session
    spark, sf = local_session(), sys.argv[1]
    con, failed = connect(sf), []
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        if name not in oracle_sql():
            print(f"{name:26s} rows only, {query(spark, sf).count()} rows, {time.time() - started:.1f} s")
            continue
        try:
            problems = compare(spark, con, query, oracle_sql()[name], sf)
        except Exception as failure:
            problems = [str(failure)[:700]]
        failed += [name] if problems else []
        print(f"{name:26s} {'DIFFERS' if problems else 'ok'} {time.time() - started:.1f} s")
        for p in problems:
            print("  ", p[:900])
    print("failed:", failed)
