"""Compare registered queries with their SQL on DuckDB: python tests/check_oracles.py [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tabscore.session import get_spark  # noqa: E402
from tabscore.sources.tables import TABLE_NAMES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.apply(lambda c: c.map(lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(_plain(v))))
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text) else text


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    a, b = normal(got), normal(want)
    if a.equals(b):
        return None if not kinds else f"(values equal) types {kinds}"
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} rows differ; types {kinds}\n{a[bad].head(3)}\n{b[bad].head(3)}"


def main() -> None:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark(cores="8", partitions=8)
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = []
    for n in names:
        t0 = time.time()
        try:
            got = queries[n](spark, folder).toPandas()
            t1 = time.time()
            if n in sql:
                diff = difference(got, con.execute(sql[n]).df())
            else:
                diff = None
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: {type(e).__name__} {str(e)[:600]}", flush=True)
            bad.append(n)
            continue
        kind = "sql " if n in sql else "rows"
        print(f"{'ok  ' if diff is None else 'DIFF'} {kind} {n} rows={len(got)} spark={t1 - t0:.2f}s sql={time.time() - t1:.2f}s", flush=True)
        if diff:
            print("   ", diff, flush=True)
            bad.append(n)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not fine: {bad}")


if __name__ == "__main__":
    main()
