"""Plans of the reports that once had nested loops."""

import pytest

from conftest import SMALL
from shelfspark.checks import load

QUERIES, _ = load()


@pytest.mark.parametrize(
    "name", ["a13_latency_percentiles", "a20_staleness_audit", "a29_eval_latency", "c18_data_quality_gate", "c01_hybrid_product_search"]
)
def test_no_nested_loop(name, spark):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
