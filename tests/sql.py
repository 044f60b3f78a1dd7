"""Compare a query with its SQL, as sets of rounded rows."""

import datetime
import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def database():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def same(spark, name, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = database().sql(sql)
    assert sorted(answer.columns) == columns, name
    at = [answer.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)
    assert got == want, name
    return len(got)
