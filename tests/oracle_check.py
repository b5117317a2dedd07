"""Compare registered queries with their SQL on the given tables (also used by pytest)."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def _key(row):
    return tuple((x is None, type(x).__name__ in ("str",), round(x, 5) if isinstance(x, float) else x) for x in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in rows]


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(sr), ""
    cur = con.execute(sql)
    oc, orr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != oc:
        return "SCHEMA", len(sr), f"{sc} vs {oc}"
    if len(sr) != len(orr):
        return "COUNT", len(sr), f"{len(sr)} vs {len(orr)}"
    a, b = sorted(sr, key=lambda r: str(_key(r))), sorted(orr, key=lambda r: str(_key(r)))
    bad = [(x, y) for x, y in zip(a, b) if not all(
        (p == q and type(p) is type(q)) for p, q in zip(x, y))]
    if not bad:
        return "ok", len(sr), ""
    near = all(all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5) for p, q in zip(x, y)) for x, y in bad)
    return ("NEAR" if near else "VALUES"), len(sr), f"{len(bad)} rows differ; {bad[0]}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from chronotrace.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = [a for a in sys.argv[2:] if not a.startswith("-")]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    orc = oracle_sql()
    tally = {}
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            status, n, msg = compare(spark, con, sf_dir, fn, orc.get(name))
        except Exception as e:  # report and go on
            status, n, msg = "ERROR", -1, str(e).split("JVM stacktrace")[0][:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        tally[status] = tally.get(status, 0) + 1
        dt = time.time() - t
        if status not in ("ok", "rows") or dt > 6 or n == 0 or "-a" in sys.argv:
            print(f"{status:7s} {name} rows={n} {dt:.1f}s {msg}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
