"""Edge rows from FIXTURES.md section 6."""

import math

from pyspark.sql import functions as F

from adlens.operators.explain import explain_findings
from adlens.operators.features import feature_stats
from adlens.operators.metrics import row_metrics
from adlens.operators.rollups import kpi_totals, platform_rollup, aggregate_by_campaign

SCHEMA = ("date date, campaign_id string, campaign_name string, impressions bigint, clicks bigint, "
          "conversions bigint, spend double, revenue double, region string, platform string")


def facts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(spend, revenue, conv=1, impr=100, clicks=10, name="A"):
    import datetime
    return (datetime.date(2024, 1, 1), "1", name, impr, clicks, conv, spend, revenue, "X", "Web")


def test_zero_spend_ieee_and_guarded(spark):
    df = facts(spark, [row(0.0, 5.0), row(0.0, 0.0), row(0.0, None), row(10.0, 20.0)])
    ieee = [r.roi for r in row_metrics(df).collect()]
    assert ieee[0] == math.inf and math.isnan(ieee[1]) and ieee[2] is None and ieee[3] == 100.0
    g = [r.roi for r in row_metrics(df, zero_mode="guarded").collect()]
    assert g[0] == math.inf and g[1] == 0.0 and g[2] is None and g[3] == 100.0


def test_all_spend_zero(spark):
    df = facts(spark, [row(0.0, 5.0), row(0.0, 1.0)])
    assert all(r.roi == 0.0 for r in row_metrics(df, zero_mode="guarded").collect())
    assert kpi_totals(df).first().roi == 0.0


def test_zero_conversions_cpa_inf(spark):
    df = facts(spark, [row(5.0, 5.0, conv=0)])
    assert row_metrics(df).first().cpa == math.inf


def test_inf_feature_gives_no_finding(spark):
    rows = [row(float(10 + i), float(10 + i)) for i in range(30)] + [row(0.0, 500.0)]
    df = row_metrics(facts(spark, rows)).withColumn("is_anomaly", F.lit(True))
    st = {r.metric: r for r in feature_stats(df, ["roi", "revenue"]).collect()}
    assert math.isnan(st["roi"].std)
    found = {r.metric for r in explain_findings(df, ["roi", "revenue"]).collect()}
    assert "roi" not in found and "revenue" in found


def test_null_and_nan_cells_skipped(spark):
    rows = [row(float(10 + i), float(10 + i)) for i in range(30)] + [row(10.0, None), row(10.0, 900.0)]
    df = facts(spark, rows).withColumn("is_anomaly", F.lit(True))
    got = explain_findings(df, ["revenue"]).collect()
    assert len(got) == 1 and got[0].value == 900.0


def test_missing_keys_and_platform(spark):
    df = facts(spark, [row(1.0, 2.0)]).drop("platform", "campaign_id", "campaign_name")
    assert platform_rollup(df) is None
    assert aggregate_by_campaign(df).columns == df.columns


def test_small_and_large_amounts_are_not_rounded(spark):
    import pytest
    from adlens.operators.rollups import campaign_rollup
    from adlens.operators.series import daily_roi
    rows = [("a", "2024-01-01", 0.00001, 0.00004)] * 3 + [("b", "2024-01-02", 1e15, 2e15 + 0.25)]
    df = spark.createDataFrame(rows, "campaign_name string, date string, spend double, revenue double").withColumns(
        {"impressions": F.lit(1), "clicks": F.lit(1)})
    got = {r.campaign_name: r for r in campaign_rollup(df).collect()}
    assert got["a"].spend == pytest.approx(3e-5) and got["a"].revenue == pytest.approx(1.2e-4)
    assert got["b"].revenue == 2e15 + 0.25
    assert {r.date: r.roi for r in daily_roi(df).collect()}["2024-01-01"] == pytest.approx(300.0)


def test_chart_series_keeps_rows_without_a_date(spark):
    from adlens.operators.report import chart_series
    df = spark.createDataFrame([("2024-01-01", 2.0), (None, 5.0)], "date string, revenue double").withColumns(
        {"spend": F.lit(1.0), "impressions": F.lit(1), "clicks": F.lit(1), "campaign_name": F.lit("c"), "platform": F.lit("p")})
    total = chart_series(df).where("chart = 'dashboard' and series = 'revenue'").agg(F.sum("y")).first()[0]
    assert total == 7.0


def test_findings_read_the_facts_three_times(spark):
    """Statistics, scores, output: rows that pass a counting function tell how often the facts are computed."""
    from pyspark.sql import functions as F

    from adlens.operators import explain as X
    from adlens.operators.features import all_stats, flag_by_contamination, zsum_score
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    n = 2000
    facts = spark.range(n).select(F.lit("2025-11-01").alias("date"), F.lit("c").alias("campaign_name"), *[
        (F.xxhash64("id", F.lit(c)) % 1000).cast("double").alias(c) for c in ("impressions", "clicks")])
    facts = facts.mapInPandas(counted, facts.schema)
    feats = ["impressions", "clicks"]
    row, stats = all_stats(facts, feats)
    X.explain_findings(flag_by_contamination(zsum_score(facts, feats, stats=row)), feats, stats).count()
    assert seen.value <= 3 * n


def test_alerts_of_rows_without_a_date_or_a_campaign(spark):
    from adlens.operators import explain as X
    from adlens.operators import forms as O
    df = spark.createDataFrame([(None, None, None, 60_000, True)], "campaign_name string, date date, region string, impressions long, is_anomaly boolean")
    r = X.row_alerts(df).first()
    assert r.description == "Unknown Campaign had unusual activity on Unknown Date in Unknown" and r.summary == "Unknown Campaign - unusual metrics on Unknown Date"
    assert O.quick_alerts(df).first().description == "Unknown Campaign - unusual metrics on Unknown Date (Unknown)"
