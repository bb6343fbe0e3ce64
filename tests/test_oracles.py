"""Every registered query against its SQL text, on the smallest driver tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from proxies import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, connection, name):
    problem = difference(spark, connection, SF, queries()[name], oracle_sql()[name])
    assert problem in (None, "EMPTY"), problem


def test_entry(spark):
    assert entry(spark).count() > 0


def test_plans_have_no_cross_join(spark):
    """Even with nothing broadcast by size."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in QUERIES.items():
            if name.startswith("stream"):
                continue
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
                assert forbidden not in plan, (name, forbidden)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["exclude_benign"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Not(In(event_type, [signup,view]))]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
