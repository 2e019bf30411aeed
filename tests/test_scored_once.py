"""Reports in one plan: scores and findings are worked out once and read, never again for each pass over them."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from adlens.operators import explain as X
from adlens.operators import grouped as G
from adlens.operators.features import flag_by_contamination, zsum_score

FEATS = ["impressions", "revenue"]


def rows(spark):
    i = F.col("id")
    return spark.range(600).select(
        F.when(i < 200, "a").when(i < 590, "b").when(i < 595, "few").otherwise("flat").alias("report"), F.lit("c").alias("campaign_name"), F.lit(None).cast("date").alias("date"),
        F.when(i >= 595, 5).when(i % 97 == 3, None).otherwise(i * 7919 % 1000).cast("bigint").alias("impressions"),
        F.when(i >= 595, 5.0).when(i % 50 == 1, float("inf")).when(i % 41 == 2, float("nan")).when(i % 23 == 0, 1e6).otherwise((i * 31 % 17) / 4).alias("revenue"), i.alias("extra"))


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_flag_reads_written_scores(spark):
    df = rows(spark)
    stats = G.report_stats(df, "report", FEATS)
    assert {r.report: r.spread for r in stats.collect()} == {"a": True, "b": True, "few": True, "flat": False}
    got = G.flag_reports(df, "report", FEATS, stats, 0.1, min_rows=6, places=6)
    assert "POWER" not in plan_of(got) and any("report-scores" in p for p in got.inputFiles())
    assert sorted(got.columns) == sorted([*df.columns, "score", "threshold", "is_anomaly"])
    for name in ("a", "b"):
        one = flag_by_contamination(zsum_score(df.where(F.col("report") == name), FEATS, places=6), 0.1)
        assert sorted((r.extra, r.score, r.is_anomaly) for r in got.where(F.col("report") == name).collect()) == [
            (r.extra, pytest.approx(r.score), r.is_anomaly) for r in one.orderBy("extra").collect()]
    assert got.where("report IN ('few', 'flat') AND (is_anomaly OR threshold IS NOT NULL)").count() == 0
    less = G.flag_reports(df, "report", FEATS, stats, 0.1, min_rows=6, places=6, keep=["extra"])
    assert sorted(less.columns) == ["extra", "is_anomaly", "report", "score", "threshold"]
    assert sorted(map(tuple, less.select("extra", "is_anomaly").collect())) == sorted(map(tuple, got.select("extra", "is_anomaly").collect()))


def test_texts_read_written_findings(spark):
    df = rows(spark)
    stats = G.report_stats(df, "report", FEATS)
    flagged = G.flag_reports(df, "report", FEATS, stats, 0.1, places=6)
    findings = X.finding_text(X.explain_findings(flagged, FEATS, G.metric_stats(stats, "report", FEATS), by=["report"]))
    got = G.texts_by_report(findings, df.select("report").distinct(), "report")
    assert any("report-findings" in p for p in got.inputFiles()) and not any("report-scores" in p for p in got.inputFiles())
    n = {r.report: r["count"] for r in findings.groupBy("report").count().collect()}
    assert {r.report: r.n for r in got.collect()} == {name: n.get(name, 0) for name in ("a", "b", "few", "flat")}
