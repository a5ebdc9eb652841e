"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest

import __spark_entry__
import compare
from answergauge.plans import oracle, workloads

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# The queries of the subpackage ``llm`` have tests of their own.
QUERIES = workloads.all_queries()
SQL = oracle.all_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_levels_and_faults_occur(spark):
    rows = QUERIES["results"](spark, "/root/testdata/sf0.01").select(
        "hallucination_level", "success_flag", "error_msg"
    )
    levels = {r[0] for r in rows.select("hallucination_level").distinct().collect()}
    assert levels == {"无", "低", "中", "高", "未知", ""}
    assert rows.where("not success_flag").count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_no_plan_multiplies_rows(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
