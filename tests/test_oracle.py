"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from larkspan.plans.more_queries import MORE_ORACLE
from larkspan.plans.oracle import ORACLE as FIRST_ORACLE
from larkspan.plans.queries import QUERIES
from larkspan.plans.review_queries import REVIEW_ORACLE

from .conftest import SMALL

ORACLE = FIRST_ORACLE | MORE_ORACLE | REVIEW_ORACLE


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else (float(v) + 0.0 if isinstance(v, float) else v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
