"""Every registered query with a SQL twin gives the same rows on the smallest tables; the others run."""

import math
from decimal import Decimal

import duckdb
import pytest

from cratemill.plans import registry
from cratemill.sources.views import BASE

SF = "/root/testdata/sf0.001"
#: Long fits; run by tests/test_learning.py instead.
SLOW = {"ML01", "ML04", "ML05", "ML06", "ML08", "ML09", "ML12", "ML14_ensemble", "ML16", "ML18", "UDF02"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in BASE:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, (int, float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.8g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.sql(f"select {quoted} from ({registry.oracle_sql()[name]}) q").fetchall()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
