"""Small recordings and the comparison of a query with its SQL."""

import os
from decimal import Decimal

import duckdb

from oxyframe.frame import SignalFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def vector(spark, x, t=None, **roles):
    roles = {"checks": False, **roles}
    times = [float(v) for v in (t if t is not None else range(1, len(x) + 1))]
    return SignalFrame.from_dict(spark, {"t": times, "x": x}, time_channel="t", channels="x", **roles)


def near(a, b, digits=9):
    f = lambda v: [round(x, digits) if isinstance(x, float) else x for x in v]
    assert f(map(_number, a)) == f(map(_number, b))


def _number(x):
    return float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def agree(df, sql, sf_dir):
    want = duck(sf_dir).sql(sql)
    names = want.columns
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    assert got == sorted(map(repr, want.fetchall()))
