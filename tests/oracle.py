"""Side-by-side comparison of a query with its SQL twin in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted((tuple(norm(r[n]) for n in names) for r in got.collect()), key=repr)
    rel = connection(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    want = sorted((tuple(norm(dict(zip(rel.columns, r))[n]) for n in names) for r in rel.fetchall()), key=repr)
    assert len(rows) == len(want), (len(rows), len(want))
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not bad, bad[:3]
    return len(rows)
