"""Compare registered queries with their SQL run by DuckDB."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) != pd.api.types.is_float_dtype(b[c]):
            if not (a[c].isna().all() and b[c].isna().all()):
                return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c], b[c]
        same = (x.isna() & y.isna()) | (x == y)
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{c}, row {i}: {x[i]!r} vs {y[i]!r} ({(~same).sum()} rows differ)"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            got = q(spark, folder)
            types = dict(got.dtypes)
            got = got.toPandas()
            took = time.time() - t
            if name in sqls:
                rel = con.execute(sqls[name])
                problem = differences(got, rel.fetchdf())
            else:
                problem = None
        except Exception as e:  # noqa: BLE001
            problem, took, got, types = f"{type(e).__name__}: {str(e)[:600]}", 0.0, [], {}
        bad += problem is not None
        kind = "" if name in sqls else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {took:.2f}s {len(got)} rows {problem or ''}", flush=True)
        if problem:
            print("     ", types)
    print("failures:", bad)
