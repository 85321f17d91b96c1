"""Run registered queries and their SQL twins side by side and compare values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v != v else str(v) if isinstance(v, str)
                          else repr(float(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a.equals(b):
        return "ok"
    # a sum may differ in its last bit and flip the last rounded digit: compare numbers closely
    text = [c for c in a.columns if not pd.api.types.is_numeric_dtype(spark_df[c])]
    keys = text + [c for c in a.columns if c not in text and (spark_df[c] % 1 == 0).all()]
    x, y = (d.sort_values(keys).reset_index(drop=True) for d in (spark_df, sql_df))
    if all(
        np.allclose(x[c].astype(float), y[c].astype(float), rtol=1e-9, atol=1e-5, equal_nan=True)
        if c not in text else (x[c].fillna("") == y[c].fillna("")).all()
        for c in a.columns
    ):
        return "ok"
    bad = (a != b).any(axis=1)
    cols = [c for c in a.columns if (a[c] != b[c]).any()]
    i = bad.idxmax()
    return f"{bad.sum()} of {len(a)} rows differ in {cols}: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"


def main() -> int:
    from barograph.plans.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1]
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                verdict = compare(got, con.execute(sql[name]).df())
            else:
                verdict = f"rows-only"
        except Exception as e:  # noqa: BLE001 - report and go on
            got, t1 = [], time.time()
            verdict = "ERROR " + str(e)[:1500]
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:34s} {len(got):7d} rows  spark {t1 - t0:5.1f}s  sql {time.time() - t1:5.1f}s  {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
