"""Every registered query against its SQL, and a look at the plans."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "id" and df.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert oracle.compare(spark, duck, SF_DIR, name, QUERIES[name], SQL[name], df) is None


@pytest.mark.parametrize("name", ["call_chain", "transitive_dependents", "dependent_paths", "impact"])
def test_walks_go_on_to_the_last_level(spark, name):
    """Walks go deeper than a view of a few levels would."""
    assert max(r.depth for r in QUERIES[name](spark, SF_DIR).select("depth").distinct().collect()) > 5


def test_dangling_rows_and_whole_tables(spark):
    kinds = {(r.kind, r.reason): r["count"] for r in QUERIES["rejects_by_reason"](spark, SF_DIR).collect()}
    assert set(kinds) == {("variable", "unknown unit"), ("field", "unknown type"), ("relationship", "unknown source"), ("relationship", "unknown target")}
    assert all(r.id.startswith("gone:") for r in QUERIES["rejects"](spark, SF_DIR).collect())
