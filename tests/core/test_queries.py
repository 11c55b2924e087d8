"""Every query beside its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from stratalens.plans import star

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(star.ORACLES))
def test_query_is_its_sql(spark, con, name):
    df = star.QUERIES[name](spark, FOLDER)
    want = con.execute(star.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = [df.columns.index(c) for c in names]
    got = sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())
