"""Holds a query's rows against DuckDB SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, columns):
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(norm(r[c]) for c in columns) for r in records)


def check(spark, query, sql, folder, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = query(spark, folder)
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert rows(df.collect(), columns) == rows(want, columns)
