"""Run registered queries against their SQL twins: python tools/check.py [sf] [name …]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} / {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    si = [spark_cols.index(c) for c in sorted(spark_cols)]
    di = [duck_cols.index(c) for c in sorted(duck_cols)]
    a = sorted(tuple(cell(r[i]) for i in si) for r in spark_rows)
    b = sorted(tuple(cell(r[i]) for i in di) for r in duck_rows)
    for x, y in zip(a, b):
        if x != y:
            at = next(i for i, (p, q) in enumerate(zip(x, y)) if p != q)
            p, q = x[at], y[at]
            k = next((j for j, (m, n) in enumerate(zip(p, q)) if m != n), min(len(p), len(q)))
            lo = max(0, k - 60)
            return f"column {sorted(spark_cols)[at]} at {k}: {p[lo:k + 60]!r} / {q[lo:k + 60]!r}"
    return None


def main() -> int:
    from corpuswright.session import build_session
    from corpuswright.queries import REGISTRY

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    chosen = [q for n, q in REGISTRY.items() if not names or any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                   "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for q in chosen:
        try:
            t = time.time()
            df = q.run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            ts = time.time() - t
            if q.sql is None:
                print(f"rows {q.name}: {len(rows)} rows {ts:.2f}s", flush=True)
                continue
            t = time.time()
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            td = time.time() - t
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            diff = compare(rows, df.columns, want, cols)
            if diff:
                bad += 1
                print(f"FAIL {q.name}: {diff}", flush=True)
            else:
                print(f"ok   {q.name}: {len(rows)} rows spark {ts:.2f}s duck {td:.2f}s {types}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {q.name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
