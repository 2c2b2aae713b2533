"""Run suite queries next to their SQL on DuckDB.

    python tests/compare.py /root/testdata/sf0.01 [name prefix …]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(df, con, sql):
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    notes = []
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for f in df.schema.fields:
        if pairs.get(f.dataType.simpleString()) != types[f.name] and types[f.name] != "STRING":
            notes.append(f"{f.name}: {f.dataType.simpleString()} / {types[f.name]}")
    if len(want) != len(got):
        return f"{len(got)} rows, expected {len(want)}; first got {got[:2]} want {want[:2]}"
    for g, w in zip(got, want):
        if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(g, w)):
            return f"got {g}\n   want {w}"
    if notes:
        return "types: " + "; ".join(notes)
    if not got:
        return "empty"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from rollcall import local_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            df = fn(spark, folder)
            problem = compare(df, con, sql[name]) if name in sql else ("no sql", df.count())[0]
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        mark = "ok " if problem is None else ("-- " if problem == "no sql" else "BAD")
        bad += mark == "BAD"
        print(f"{mark} {name:34s} {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
