"""Runs registered queries against their SQL on the same tables.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, query, sql: str | None, sf: str) -> tuple[str, float]:
    started = time.perf_counter()
    df = query(spark, f"{DATA}/{sf}")
    got = [tuple(r) for r in df.collect()]
    seconds = time.perf_counter() - started
    if sql is None:
        return (f"rows={len(got)}" if got else "EMPTY"), seconds
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", seconds
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        kinds = {c: str(t) for c, t in zip(names, (d[1] for d in cur.description))}
        bad = [c for c, t in kinds.items() if t in ("HUGEINT", "FLOAT") or t.startswith("DECIMAL")]
        return (f"ok rows={len(a)}" if not bad else f"TYPES {bad}"), seconds
    only_a = [x for x in a if x not in b][:3] if len(a) < 5000 else []
    only_b = [x for x in b if x not in a][:3] if len(a) < 5000 else []
    if len(a) >= 5000:
        pairs = [(x, y) for x, y in zip(a, b) if x != y][:2]
        only_a, only_b = [p[0] for p in pairs], [p[1] for p in pairs]
    return f"DIFF {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}", seconds


def main() -> None:
    from lineguard.plans import catalog
    from lineguard.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    bad = 0
    for name, query in catalog.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            outcome, seconds = compare(spark, con, name, query, catalog.oracles().get(name), sf)
        except Exception as exc:  # report and go on with the next query
            outcome, seconds = f"ERROR {type(exc).__name__}: {str(exc).splitlines()[0][:300]}", 0.0
        bad += not outcome.startswith(("ok", "rows="))
        print(f"{name:36s} {seconds:6.2f}s  {outcome}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
