"""Physical-plan properties that matter at scale (checked with explain, no execution)."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_limited_before_the_shuffle(spark):
    p = _plan(spark, "retrieval_metrics")
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["leaderboard_top15", "enriched_runs", "features_full", "roc_auc",
                                  "breakdown_by_dim", "request_features", "tfidf", "knn_in_class"])
def test_no_cartesian_product(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p


def test_scan_prunes_columns_and_unused_joins(spark):
    """Text features need two order columns: the scan reads only those, and the left join to the per-run
    retrieval aggregate (unique on the key, unused columns) is removed, so lineitem is never read."""
    p = _plan(spark, "text_features")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "lineitem" not in p


def test_leaderboard_is_take_ordered(spark):
    p = _plan(spark, "leaderboard_top15")
    assert "TakeOrderedAndProject" in p


def test_breakdown_scans_runs_once(spark):
    """All six dimensions in one aggregation: orders are scanned once, not once per dimension."""
    p = _plan(spark, "breakdown_by_dim")
    assert p.count("orders.parquet") == 1
