"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from sitelens.session import TABLES, local_session  # noqa: E402


def norm_value(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm_value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm_value(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(norm_value(r[c]) for c in cols) for r in df.to_dict("records"))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:2000]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS-ONLY {name}: {len(sdf)} rows ({ts:.1f}s)")
            continue
        try:
            odf = con.execute(sqls[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:2000]}")
            bad += 1
            continue
        a, b = digest(sdf), digest(odf)
        ok = a[:3] == b[:3]
        if not ok:
            bad += 1
            print(f"MISMATCH {name}: spark rows={a[0]} cols={a[1]} | oracle rows={b[0]} cols={b[1]}")
            sa, sb = set(a[3]), set(b[3])
            for r in sorted(sa - sb)[:3]:
                print("   spark-only:", r[:400])
            for r in sorted(sb - sa)[:3]:
                print("   oracle-only:", r[:400])
        else:
            print(f"OK {name}: {a[0]} rows ({ts:.1f}s)")
    print("bad:", bad)


if __name__ == "__main__":
    main()
