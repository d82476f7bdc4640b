"""Rows of a query against rows of its SQL, order aside."""

import decimal
import math

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = query(spark, folder)
    names = sorted(got.columns)
    want = con.sql(sql)
    assert names == sorted(want.columns)
    a = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
    return [] if a == b else [(x, y) for x, y in zip(a, b) if x != y][:3] + [len(a), len(b)]
