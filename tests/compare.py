"""Runs queries beside their SQL and compares the rows.

python -m tests.compare SF [NAME...]
"""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("LOOM_TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes edges pkg_tree topic_tree manifest source_files mix_targets".split()


def entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, value(x)) for k, x in v.asDict().items()))
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def same(spark, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = duck(sf_dir).execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(cols)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(map(repr, got)), set(map(repr, want))
    return False, f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"


def main(argv):
    from loomgraph.session import local_session

    e = entry_module()
    q, o = e.queries(), e.oracle_sql()
    spark = local_session()
    bad = 0
    for name in argv[1:] or q:
        t = time.time()
        try:
            ok, note = same(spark, str(DATA / argv[0]), q[name], o[name]) if name in o else (True, f"{q[name](spark, str(DATA / argv[0])).count()} rows, no SQL")
        except Exception as x:  # noqa: BLE001
            ok, note = False, repr(x)[:1500]
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
