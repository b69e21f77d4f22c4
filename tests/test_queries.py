"""Every registered query with SQL gives what its SQL gives in DuckDB, from a plan without pairwise
joins and without Python."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
import compare
from geoscope.plans.registry import ORACLES


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


FORBIDDEN = (
    "NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "InPandas",
)

# These pass rows through fitted MLlib stages, which Spark plans as (JVM) functions of its own.
MODELS = {"class_codes", "predict_mass_check", "predict_mass_blend_check", "predict_class_check"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, con):
    result = entry.queries()[name](spark, SMALL)
    if name not in MODELS:
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert not [f for f in FORBIDDEN if f in plan]
    problem, _ = compare.difference(name, spark, con, SMALL, result)
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
