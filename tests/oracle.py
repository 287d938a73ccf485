"""Comparison of a query with its SQL in DuckDB, rows in any order, doubles to nine digits."""

import os
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of_sql(folder, sql):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)


def rows_of_df(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def check(spark, folder, query, sql):
    assert rows_of_df(query(spark, folder)) == rows_of_sql(folder, sql)
