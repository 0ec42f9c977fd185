"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tracewell.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    res = duck.execute(ORACLES[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in res.fetchall())
