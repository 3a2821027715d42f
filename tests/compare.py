"""Run queries and their SQL side by side: python tests/compare.py SF [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if isinstance(v, float):
        return ("f", v) if not math.isnan(v) else ("f", "nan")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main():
    import duckdb

    import __spark_entry__ as e
    from waygraph.runtime import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/{sf}"
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM '{p}'")
    bad = []
    q, sql = e.queries(), e.oracle_sql()
    for name in names or q:
        t = time.time()
        try:
            df = q[name](spark, d)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - t
            if name not in sql:
                print(f"{name}: {len(rows)} rows, {took:.1f} s, no SQL", flush=True)
                continue
            t = time.time()
            rel = con.sql(sql[name])
            order = [rel.columns.index(c) for c in cols]
            want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
            same = sorted(map(repr, rows)) == sorted(map(repr, want))
            print(f"{name}: {len(rows)} and {len(want)} rows, {took:.1f} s, SQL {time.time() - t:.1f} s, {'same' if same else 'DIFFERENT'}", flush=True)
            if not same:
                bad.append(name)
                print("  ", cols, sorted(set(map(repr, rows)) - set(map(repr, want)))[:3], sorted(set(map(repr, want)) - set(map(repr, rows)))[:3])
        except Exception as x:
            bad.append(name)
            print(f"{name}: ERROR {str(x)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
