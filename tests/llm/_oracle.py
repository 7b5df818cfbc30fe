"""Run DuckDB SQL over DataFrames and compare rows, as text and in any order."""

import duckdb


def oracle(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(names)
    return order, sorted([tuple(r[names.index(c)] for c in order) for r in cur.fetchall()], key=str)


def rows(df):
    order = sorted(df.columns)
    return order, sorted([tuple(r[c] for c in order) for r in df.collect()], key=str)
