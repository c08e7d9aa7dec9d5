"""Every query of the catalogue against its SQL counterpart."""

import pytest

from __spark_entry__ import entry
from listingloom.plans.catalog import CATALOG
from listingloom.plans.oracles import ORACLES
from tests.compare import compare, duckdb_on

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_on(FOLDER)


def test_every_query_has_sql():
    assert set(CATALOG) == set(ORACLES)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    df = CATALOG[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # all work stays in the engine, and nothing is paired with everything
    for word in ("PythonUDF", "ArrowEval", "InPandas", "Join Cross", "CartesianProduct"):
        assert word not in plan
    assert compare(con, df, ORACLES[name]) == ""


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 18 and df.count() == 150
