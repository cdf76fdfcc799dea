"""Compare a query with its SQL on the same parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(values):
    return sorted(values, key=lambda r: tuple((x is not None, str(x)) for x in r))


def same(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = rows([tuple(r) for r in df.select(*columns).collect()])
    q = connect(sf_dir).sql(sql)
    assert sorted(q.columns) == columns
    want = rows(connect(sf_dir).sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert got == want
    return len(got)
