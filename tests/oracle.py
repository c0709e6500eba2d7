"""Compares registered queries with their SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, sf_dir, query, text):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    want = con.sql(text)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b
