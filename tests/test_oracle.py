"""Every registered query against its DuckDB oracle on the smallest data set."""
import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
_SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(_SQL[name]).df()
    r = compare(got, want)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r.get("exact") or r.get("tol_ok"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "accuracy" in df.columns
