"""Every registered query against its SQL on the smallest scale."""

import pytest

from tools.check import digest, oracle_rows
from workload.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    columns, _, expected = oracle_rows(FOLDER, ORACLES[name])
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, got)[0] == digest(columns, expected)[0]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
