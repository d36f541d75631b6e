"""Runs a query and its SQL and compares the rows."""

import os

import duckdb


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [shown(v) for v in value]
    return value


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = connect(sf_dir).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
    theirs = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert ours == sorted(repr([shown(r[c]) for c in columns]) for r in theirs)
