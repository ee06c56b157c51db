"""Every registered query against its SQL on the smallest tables."""

import pytest

from queries import all_queries
from tests.check import TESTDATA, compare, connection

SF_DIR = f"{TESTDATA}/sf0.001"
REGISTRY = all_queries()


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY.spark))
def test_agrees_with_sql(spark, con, name):
    plans = []

    def run(session, sf_dir):
        df = REGISTRY.spark[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    problem = compare(spark, con, SF_DIR, run, REGISTRY.sql.get(name))
    assert problem in ("", "both empty"), problem
    assert "CartesianProduct" not in plans[0] and "NestedLoopJoin" not in plans[0]


def test_every_query_has_sql():
    assert set(REGISTRY.sql) == set(REGISTRY.spark)
