"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from meshtally.plans import registered  # noqa: E402
from tools.check_queries import connect, differences, duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = registered.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    got = spark_rows(df)
    assert got[1], name
    assert differences(got, duck_rows(duck, registered.SQL[name])) is None


def test_every_query_has_sql():
    assert set(registered.SQL) == set(registered.QUERIES) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["hops", "total", "missed", "pdr"] and df.count() > 0
