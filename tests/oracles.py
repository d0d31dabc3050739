"""Comparing a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(int(x) if isinstance(x, bool) else x for x in r)) for r in rows)


def agree(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == names
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()]
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({sql}) q").fetchall()
    assert plain(got) == plain(want)
