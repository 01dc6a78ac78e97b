"""Every registered relational query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fusewright import catalogue

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return float("%.9g" % v) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    r = duck.execute(SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(x[cols.index(c)]) for c in names) for x in r.fetchall()), key=repr)
    assert got == want
