"""Run a query and its DuckDB SQL on the same tables and compare their rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(names)
    kinds = {n: str(d[1]) for n, d in zip(names, cur.description)}
    return order, kinds, sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=str)


def spark_rows(df):
    order = sorted(df.columns)
    return order, dict(df.dtypes), sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
