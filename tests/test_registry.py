"""Driver contract: entry runs, every query builds, oracle keys are queries."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"metric", "score", "partition", "observations"}


def test_oracles_cover_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_some_queries_run_on_tiny_data(spark):
    q = E.queries()
    for name in ["evl3_roc_auc", "agg3_category_target_connection", "drf3_dataset_shift_report", "srv1_score_requests"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
