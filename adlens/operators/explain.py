"""Findings: which metric of a flagged row is unusual, and the texts about it.

Plan: the flagged rows are unpivoted to (row keys, metric, value) -- a narrow
projection, no shuffle -- and joined to the per-feature statistics, which are
one row per feature and therefore a bounded broadcast. Summaries use grouping
sets with partial aggregation; "first k" lists have an explicit order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.numeric import INF, fmt_plain, round2
from adlens.functions.text import (
    NO_FINDINGS_SENTENCE,
    display_name,
)
from adlens.operators.features import feature_stats
from adlens.operators.rows import once, one_row

SEVERITIES = ["high", "medium", "low"]


def unpivot_features(df: DataFrame, feature_cols: list[str], ids: list[str]) -> DataFrame:
    """(ids, metric, value) rows; ``unpivot`` is a narrow Expand, no shuffle."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in feature_cols])
    return casted.unpivot(ids, feature_cols, "metric", "value")


def explain_findings(scored: DataFrame, feature_cols: list[str], stats: DataFrame | None = None,
                     ids: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """D7-D10 (+D11): one row per (flagged row, metric) with z > 2.

    ``scored`` holds the raw feature values and ``is_anomaly``; statistics are
    over all rows of ``scored`` unless given. ``by``: columns of ``scored`` and
    ``stats`` that name a row's report; each report has its own statistics then.
    """
    if stats is None:
        stats = feature_stats(scored, feature_cols)
    by = by or []
    ids = by + (ids or [c for c in ["date", "campaign_id", "campaign_name", "region"] if c in scored.columns])
    long = unpivot_features(scored.where(F.col("is_anomaly")), feature_cols, ids)
    st = stats.select(*by, "metric", F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    st = st if by else F.broadcast(st)  # one row per feature, or as many more as there are reports
    v, m, s = F.col("value"), F.col("__mean"), F.col("__std")
    z = F.abs(v - m) / s
    ok = (
        v.isNotNull() & ~F.isnan(v) & s.isNotNull() & ~F.isnan(s) & (s != F.lit(INF)) & (s > 0)
        & m.isNotNull() & ~F.isnan(m) & (F.abs(m) != F.lit(INF))
    )
    j = long.join(st, [*by, "metric"]).where(ok).withColumn("z", z).where(~F.isnan("z") & (F.col("z") > 2))
    pct = F.when(m != 0, (v - m) / m * 100).otherwise(F.lit(0.0))
    out = j.withColumns({
        "severity": F.when(F.col("z") > 3, "high").when(F.col("z") > 2.5, "medium").otherwise("low"),
        "direction": F.when(v < m, "below").otherwise("above"),
        "pct_diff": pct,
        "expected_lo": round2(m - 2 * s),
        "expected_hi": round2(m + 2 * s),
    })
    return out.withColumn("value", round2(v)).drop("__mean", "__std")


def finding_text(df: DataFrame) -> DataFrame:
    """D11: '<Metric> dropped|spiked p% below|above average for <campaign> on <date>[ in <region>]'."""
    pct = F.col("pct_diff")
    head = F.when(
        F.col("direction") == "below",
        F.concat(display_name(F.col("metric")), F.lit(" dropped "), fmt_plain(F.abs(pct), 1), F.lit("% below average")),
    ).otherwise(F.concat(display_name(F.col("metric")), F.lit(" spiked "), fmt_plain(pct, 1), F.lit("% above average")))
    region = F.col("region") if "region" in df.columns else F.lit(None).cast("string")
    desc = F.concat(
        head, F.lit(" for "), F.coalesce(F.col("campaign_name"), F.lit("Unknown Campaign")),
        F.lit(" on "), F.coalesce(F.col("date").cast("string"), F.lit("Unknown Date")),
        F.when(F.coalesce(region, F.lit("")) != "", F.concat(F.lit(" in "), region)).otherwise(F.lit("")),
    )
    return df.withColumn("description", desc)


def alert_summary() -> F.Column:
    """The short text about a flagged row."""
    return F.concat(F.coalesce("campaign_name", F.lit("Unknown Campaign")), F.lit(" - unusual metrics on "), F.coalesce(F.col("date").cast("string"), F.lit("Unknown Date")))


def row_alerts(flagged: DataFrame) -> DataFrame:
    """One alert per flagged row; severity high when impressions < 50,000."""
    region = F.coalesce(F.col("region"), F.lit("Unknown"))
    return flagged.where(F.col("is_anomaly")).select(
        "campaign_name", "date", region.alias("region"), "impressions",
        F.when(F.col("impressions") < 50000, "high").otherwise("medium").alias("severity"),
        F.concat(F.coalesce("campaign_name", F.lit("Unknown Campaign")), F.lit(" had unusual activity on "),
                 F.coalesce(F.col("date").cast("string"), F.lit("Unknown Date")), F.lit(" in "), region).alias("description"),
        alert_summary().alias("summary"),
    )


def anomaly_summary(findings: DataFrame) -> DataFrame:
    """Total, by severity (all three present), by metric, by campaign -- long form.

    One grouping-sets aggregation (a single scan, partial aggregation); the three
    severities are a fixed list joined from the left so a zero count still shows.
    """
    g = (
        findings.groupingSets([[], ["severity"], ["metric"], ["campaign_name"]], "severity", "metric", "campaign_name")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )
    # gid bits: severity=4, metric=2, campaign_name=1 (1 = not grouped)
    dim = (
        F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "severity")
        .when(F.col("gid") == 5, "metric").otherwise("campaign")
    )
    key = F.when(F.col("gid") == 7, F.lit("all")).when(F.col("gid") == 3, F.col("severity")) \
        .when(F.col("gid") == 5, F.col("metric")).otherwise(F.col("campaign_name"))
    long = g.select(dim.alias("dimension"), key.alias("key"), F.col("n").cast("bigint").alias("n"))
    spark = findings.sparkSession
    zeros = spark.createDataFrame([("severity", s, 0) for s in SEVERITIES] + [("total", "all", 0)],
                                  "dimension string, key string, n bigint")
    # the findings are aggregated once; the fixed keys are added as zero rows and the
    # (few hundred) summary rows summed again
    return long.unionByName(zeros).groupBy("dimension", "key").agg(F.sum("n").cast("bigint").alias("n"))


def top_findings(findings: DataFrame, k: int = 10, cut: int = 70) -> DataFrame:
    """First k findings by (z desc, date, campaign, metric), text cut to ``cut`` chars."""
    return (
        findings.orderBy(F.desc("z"), "date", "campaign_name", "metric", "value")
        .limit(k)
        .select("date", "campaign_name", "metric", "severity", "value",
                F.substring("description", 1, cut).alias("alert"))
    )


def findings_text(findings: DataFrame, k: int = 5) -> DataFrame:
    """Fixed sentence when there are none, else a header and the first k as bullets.

    The first-k rows come from a top-k (bounded), then one small aggregate.
    """
    findings = once(findings)
    n = findings.agg(F.count(F.lit(1)).alias("n"))
    first = (
        findings.orderBy(F.desc("z"), "date", "campaign_name", "metric", "value").limit(k)
        .agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(
                (-F.col("z")).alias("o1"), F.col("date").alias("o2"), F.col("campaign_name").alias("o3"),
                F.col("metric").alias("o4"), F.col("value").alias("o5"), F.col("description").alias("d")))),
            lambda s: F.concat(F.lit("- "), s["d"])), "\n").alias("bullets"))
    )
    return one_row(n, first).select(
        "n",
        F.when(F.col("n") == 0, F.lit(NO_FINDINGS_SENTENCE)).otherwise(
            F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" anomalies detected:**\n\n"),
                     F.col("bullets"), F.lit("\n"))
        ).alias("text"),
    )


def overlay(daily: DataFrame, findings: DataFrame, metric: str) -> DataFrame:
    """The daily series of ``metric`` with a mark on dates that have a finding of that metric.

    The finding dates are distinct days (bounded by the calendar); left join + flag.
    """
    marks = findings.where(F.col("metric") == metric).select("date").distinct().withColumn("__m", F.lit(True))
    return daily.select("date", metric).join(marks, "date", "left").select(
        "date", metric, F.coalesce("__m", F.lit(False)).alias("is_marked")
    )


def flagged_row_index(flagged: DataFrame, order_by: list[str]) -> DataFrame:
    """0-based position of each flagged row among the flagged rows, in an explicit order.

    The reference numbers flagged rows in input order, which a distributed
    table does not have; the order is a parameter. Numbered by a distributed
    sort plus per-partition offsets, not a single-partition window.
    """
    from adlens.operators.rowid import row_index
    return row_index(flagged.where(F.col("is_anomaly")), "row_index", start=0, order_by=order_by)
