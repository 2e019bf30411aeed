"""Daily series: ROI per day, average line, day-over-day change, axis labels.

Every function starts from the per-day aggregate (``aggregate_by_date``),
so the rows that reach a window are one per calendar day (a few thousand at
most, whatever the fact volume). Only those windows that need a global order
(``day_over_day``, ``axis_labels``) use an unpartitioned window, and they see
the per-day rows only. The per-campaign variant partitions by campaign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numeric import fdiv, raw_sum, safe_ratio
from adlens.operators.rollups import _sum, aggregate_by_date


def daily_roi(df: DataFrame, guarded: bool = True, money=raw_sum) -> DataFrame:
    """Per-day revenue, spend and ROI, not rounded; with spend <= 0 it is 0 (guarded) or as IEEE division has it."""
    d = df.groupBy("date").agg(_sum("revenue", money).alias("revenue"), _sum("spend", money).alias("spend"))
    roi = (
        safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0)
        if guarded else fdiv(F.col("revenue") - F.col("spend"), "spend") * 100
    )
    return d.withColumn("roi", roi).orderBy("date")


def daily_vs_avg(df: DataFrame, metric: str = "roi", money=raw_sum) -> DataFrame:
    """A daily series beside its mean over all days: ROI, or the daily sum of any metric.

    The mean is a window over the daily rows (one for each calendar day), so the facts are read once.
    """
    d = daily_roi(df, money=money) if metric == "roi" else df.groupBy("date").agg(_sum(metric, money).alias(metric))
    avg = f"avg_{metric}"
    return d.withColumn(avg, F.avg(metric).over(Window.partitionBy())).withColumn("above_avg", F.col(metric) > F.col(avg))


def _pct_change(x, prev):
    return fdiv(x - prev, prev) * 100


def _sign_class(change):
    c = F.coalesce(F.nanvl(change, F.lit(0.0)), F.lit(0.0))
    return F.when(c >= 0, F.lit("good")).otherwise(F.lit("bad"))


def day_over_day(df: DataFrame, metric: str = "revenue", periods: int = 1, money=raw_sum) -> DataFrame:
    """Percent change against the row ``periods`` days earlier in the daily series."""
    d = df.groupBy("date").agg(_sum(metric, money).alias(metric))
    w = Window.orderBy("date")
    prev = F.lag(metric, periods).over(w)
    return d.withColumn("prev", prev).select(
        "date", metric,
        _pct_change(F.col(metric), F.col("prev")).alias("change_pct"),
    ).withColumn("sign", _sign_class(F.col("change_pct")))


def campaign_day_over_day(df: DataFrame, metric: str = "revenue", periods: int = 1, money=raw_sum) -> DataFrame:
    """T3 per campaign: windows partitioned by campaign over its daily rows."""
    d = df.groupBy("campaign_name", "date").agg(_sum(metric, money).alias(metric))
    w = Window.partitionBy("campaign_name").orderBy("date")
    return d.withColumn("prev", F.lag(metric, periods).over(w)).select(
        "campaign_name", "date", metric,
        _pct_change(F.col(metric), F.col("prev")).alias("change_pct"),
    ).withColumn("sign", _sign_class(F.col("change_pct")))


def metric_trend(df: DataFrame, metric: str = "impressions") -> DataFrame:
    """T5: daily sum of one metric."""
    return aggregate_by_date(df, metrics=[metric])


def axis_labels(df: DataFrame, n_labels: int = 5) -> DataFrame:
    """MM-DD text on every max(1, n // n_labels)-th day."""
    days = df.select("date").where(F.col("date").isNotNull()).distinct()
    w = Window.orderBy("date")
    wa = Window.partitionBy()
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(wa) / n_labels))
    return (
        days.withColumns({"pos": F.row_number().over(w) - 1, "step": step})
        .where(F.col("pos") % F.col("step") == 0)
        .select("date", F.col("pos").cast("bigint").alias("pos"), F.date_format("date", "MM-dd").alias("label"))
    )
