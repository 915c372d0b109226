"""Every core query against its SQL on the smallest tables."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from corvane.plans.queries import ORACLES, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[x]) for x in names) for r in df.collect())
    if name in ORACLES:
        want = sql.sql(ORACLES[name])
        assert sorted(want.columns) == names
        at = [want.columns.index(x) for x in names]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
