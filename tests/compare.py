"""Rows of a query and of its SQL, made comparable."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()), columns


def sql_rows(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    columns = sorted(names)
    place = {c: i for i, c in enumerate(names)}
    return sorted(tuple(plain(r[place[c]]) for c in columns) for r in result.fetchall()), columns
