"""Run registered queries next to their SQL in DuckDB and compare the results.

    python tools/check.py [name ...] [--sf 0.01] [--family curation]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cadenza.catalog import load  # noqa: E402
from cadenza.catalog.views import TABLES  # noqa: E402
from cadenza.session import local_session  # noqa: E402


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--family", default=None)
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    reg = load()
    texts = reg.sql_texts()
    wanted = args.names or [n for n in reg.QUERIES if not args.family or reg.FAMILY[n] in args.family.split(",")]
    spark = local_session(cores=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = reg.QUERIES[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(e)[:1500]}")
            continue
        t1 = time.time()
        if name not in texts:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s {df.columns}")
            bad += not got
            continue
        try:
            cur = con.execute(texts[name])
            dcols = [(d[0], str(d[1])) for d in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb {str(e)[:1500]}")
            continue
        t2 = time.time()
        types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        st = {f.name: types.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dt = dict(dcols)
        note = "" if st == dt else f" TYPES { {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)} }"
        a, b = rows_of(df.columns, got), rows_of([c for c, _ in dcols], want)
        ok = a == b and not note and len(got) > 0
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)}/{len(want)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{note}")
        if a != b:
            sa, sb = set(a), set(b)
            print("   ", sorted(df.columns))
            for r in list(sorted(sa - sb))[:3]:
                print("    spark", str(r)[:600])
            for r in list(sorted(sb - sa))[:3]:
                print("    duck ", str(r)[:600])
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
