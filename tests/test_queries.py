"""Every registered query that SQL can express, against that SQL; the others against their shape."""

from __future__ import annotations

import pytest
from conftest import SF

from fairspark.plans import io_queries, queries
from fairspark.plans.queries import flagship

QUERIES, SQL = {**queries.QUERIES, **io_queries.QUERIES}, {**queries.SQL, **io_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_flagship(spark):
    assert flagship(spark, SF).count() == 4


def test_three_sets_shares_add_up(spark):
    rows = QUERIES["three_sets_distribution"](spark, SF).groupBy("set").sum("share").collect()
    assert len(rows) == 3
    assert all(abs(r[1] - 1) < 1e-9 for r in rows)


def test_model_assessment(spark):
    rows = QUERIES["model_assess_decision_tree"](spark, SF).collect()
    assert len(rows) == 5
    assert all(r.performance_accuracy > 0.9 and 0 <= r.fairness_consistency <= 1 for r in rows)


def test_pipeline_search(spark):
    rows = QUERIES["pipeline_search"](spark, SF).collect()
    assert len(rows) == 2
    for r in rows:
        assert 0 <= r.decision_tree_performance_accuracy <= 1
        assert r.gaussian_nb_sse_consistency >= 0
        assert r.decision_tree_performance_aucmean <= 1
