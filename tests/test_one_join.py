"""Queries of several passes join the facts once: what they return is read from the kept facts, not from lineitem."""

import pytest
from pyspark.sql import functions as F

from adlens.operators.iforest import IsolationForest
from adlens.operators.rows import stored
from adlens.plans import catalog as C
from adlens.plans import file_queries, findings_queries, many_queries, normalize_queries, report_queries

QUERIES = ["context_json", "context_document_fields", "normalize_date_formats", "report_bundle", "anomaly_context", "forest_findings", "isolation_forest",
           "anomaly_overlay", "summary_text", "contamination_flag", "status_text", "reports_text", "reports_findings", "reports_flag", "top_anomalies",
           "findings_text", "row_alerts", "anomaly_json_fields", "folder_reports", "alert_lines_quick"]


@pytest.mark.parametrize("name", QUERIES)
def test_facts_are_joined_once(spark, sf_small, monkeypatch, name):
    from adlens.sources.facts import ad_facts
    joined = []
    for module in (file_queries, findings_queries, many_queries, normalize_queries, report_queries, C):
        monkeypatch.setattr(module, "ad_facts", lambda *a, **k: joined.append(1) or ad_facts(*a, **k))
    got = C.queries()[name](spark, sf_small)
    assert len(joined) == 1
    assert not [p for p in got.inputFiles() if "lineitem" in p]


def test_pool_from_hashes_equals_that_from_all_distinct_rows(spark):
    # one vector half of the table, some pairs, the rest single; -0.0 is 0.0
    i = F.col("id")
    x = spark.range(20_000).select(F.when(i % 2 == 0, F.when(i % 4 == 0, 0.0).otherwise(-0.0)).otherwise((i / 6).cast("long").cast("double")).alias("f0"), (i % 3 * 0.5).alias("f1"))
    for seed in range(3):
        est = IsolationForest(["a", "b"], n_trees=10, max_samples=256, seed=seed)
        assert (est._pool(*est._drawn_counts(x)) == est._pool(est._counts(x))).all()
    est = IsolationForest(["a", "b"], n_trees=100)  # fewer rows than places
    assert (est._pool(*est._drawn_counts(x)) == est._pool(est._counts(x))).all()


def test_stored_rows_are_the_rows(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, float("-inf"), "a"), (None, -0.0, "")], "k long, x double, s string").withColumn("v", F.lit(None))
    got = stored(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert stored(df.limit(0)).count() == 0
