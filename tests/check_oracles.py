"""Run registered queries and their DuckDB texts side by side: python tests/check_oracles.py [names...]"""

from __future__ import annotations

import datetime as dt
from collections import Counter
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, q, sf_dir):
    """None when equal, else a description of the first difference."""
    df = q.run(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return None if got else "no rows"
    res = con.execute(q.sql)
    cols = [d[0] for d in res.description]
    want, wcols = rows_of(cols, res.fetchall())
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    extra, lost = Counter(map(repr, got)), Counter(map(repr, want))
    a, b = sorted((extra - lost).elements()), sorted((lost - extra).elements())
    if a or b:
        return f"{len(a)} of {len(got)} rows differ {gcols}; spark {a[:2]} duckdb {b[:2]}"
    return None if got else "no rows (equal)"


def main():
    from tidebar.plans.catalog import QUERIES
    from tidebar.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    spark, con = build_session(), connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            msg = compare(spark, con, QUERIES[name], sf_dir)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s {'' if QUERIES[name].sql else '(rows only) '}{msg or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
