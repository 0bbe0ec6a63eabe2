"""Plan-shape guard: no registered query plans a cartesian product or a nested-loop join."""

import pytest

from stratum.plans.catalog import load_all
from tests.conftest import SF_SMALL

QUERIES = load_all()[0]
#: fit many models before they return a table that they made on the driver; their plans have no join
SLOW = {"train_select", "grid_search", "tune_families", "compare_balancers_ttest", "vote_soft", "grid_search_mlp", "learner_properties"}
NAMES = sorted(set(QUERIES) - SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
