"""Run registered queries against their DuckDB oracles: ``python tests/compare.py sf0.01 [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA / sf / (t + '.parquet')}'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return normal(v.item())
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def check(spark, con, name, build, sql, sf):
    got = build(spark, str(DATA / sf))
    columns, rows = got.columns, [tuple(r) for r in got.collect()]
    if sql is None:
        return f"rows-only {len(rows)}"
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    assert sorted(columns) == sorted(names), f"columns {sorted(columns)} vs {sorted(names)}"
    a, b = rows_of(columns, rows), rows_of(names, expected)
    if a != b:
        in_a, in_b = set(a), set(b)
        left, right = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
        raise AssertionError(f"{len(a)} vs {len(b)} rows; spark only {left}; oracle only {right}")
    return f"match {len(a)}"


def main():
    from barloom.session import build
    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            print(f"{name:40s} {check(spark, con, name, fn, oracles.get(name), sf)} {time.time() - start:.1f}s", flush=True)
        except Exception as e:
            failed.append(name)
            text = str(e) if isinstance(e, AssertionError) else "".join(traceback.format_exception_only(e))[:700]
            print(f"{name:40s} FAIL {time.time() - start:.1f}s {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
