"""A query's rows against DuckDB's over the same Parquet files."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def canonical(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if v != v else repr(v)
    if isinstance(v, bool):
        return repr(v)
    return repr(float(v)) if isinstance(v, int) else repr(str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())
