"""Totals, rollups, rankings and the table profile.

All are hash aggregations with partial (map-side) aggregation, so a hot group
key costs one partial row per task before the shuffle, whatever its size.
Ratios on totals are computed from the totals, never as means of row ratios.
Money sums are plain sums; registered queries pass ``money=money_sum`` to round them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numeric import fmt_num, raw_sum, round2, roundn, safe_ratio

INT_METRICS = ["impressions", "clicks", "conversions"]
MONEY_METRICS = ["spend", "revenue"]


def _sum(col: str, money=raw_sum):
    return money(col) if col in MONEY_METRICS else F.sum(col).cast("bigint")


def _zero(col: str):
    return F.lit(0.0) if col in MONEY_METRICS else F.lit(0).cast("bigint")


def kpi_totals(df: DataFrame, *extra, money=raw_sum) -> DataFrame:
    """A1: grand totals (missing metric -> 0) and ratios from the totals.

    ``extra`` aggregate columns ride along in the same single pass.
    """
    cols = set(df.columns)
    sums = [
        (_sum(m, money) if m in cols else _zero(m)).alias(m)
        for m in ["impressions", "clicks", "conversions", "revenue", "spend"]
    ]
    t = df.agg(*sums, *extra).na.fill(0, INT_METRICS).na.fill(0.0, MONEY_METRICS)
    return t.withColumns({
        "roi": safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0),
        "ctr": safe_ratio("clicks", "impressions", 100.0),
        "conversion_rate": safe_ratio("conversions", "clicks", 100.0),
    })


def aggregate_by_date(df: DataFrame, date_col: str = "date", metrics: list[str] | None = None,
                      money=raw_sum) -> DataFrame:
    """A2: per-day sums of whichever metrics exist, ordered by date."""
    ms = [m for m in (metrics or INT_METRICS + MONEY_METRICS) if m in df.columns]
    return df.groupBy(date_col).agg(*[_sum(m, money).alias(m) for m in ms]).orderBy(date_col)


def aggregate_by_campaign(df: DataFrame, money=raw_sum) -> DataFrame:
    """A3: sums per (campaign_id, campaign_name), whichever keys exist; none -> input unchanged."""
    keys = [k for k in ("campaign_id", "campaign_name") if k in df.columns]
    if not keys:
        return df
    ms = [m for m in INT_METRICS + MONEY_METRICS if m in df.columns]
    return df.groupBy(*keys).agg(*[_sum(m, money).alias(m) for m in ms])


def campaign_summary(df: DataFrame, money=raw_sum) -> DataFrame:
    """A4: per campaign name, 5 sums (null -> 0), ctr to 2 places, roi to 1, revenue desc."""
    g = df.groupBy("campaign_name").agg(*[F.coalesce(_sum(m, money), _zero(m)).alias(m) for m in INT_METRICS + MONEY_METRICS])
    return g.withColumns({
        "ctr": round2(safe_ratio("clicks", "impressions", 100.0)),
        "roi": roundn(safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0), 1),
    }).orderBy(F.desc("revenue"), "campaign_name")


def campaign_rollup(df: DataFrame, money=raw_sum) -> DataFrame:
    """A5: impressions, clicks, revenue, spend per campaign name, revenue desc."""
    return (
        df.groupBy("campaign_name")
        .agg(*[_sum(m, money).alias(m) for m in ["impressions", "clicks", "revenue", "spend"]])
        .orderBy(F.desc("revenue"), "campaign_name")
    )


def campaign_compare(df: DataFrame, metric: str = "revenue", money=raw_sum) -> DataFrame:
    """One metric per campaign (name, else id), metric desc."""
    key = "campaign_name" if "campaign_name" in df.columns else "campaign_id"
    return df.groupBy(key).agg(_sum(metric, money).alias(metric)).orderBy(F.desc(metric), key)


def platform_rollup(df: DataFrame, wide: bool = False, money=raw_sum) -> DataFrame | None:
    """Revenue (lean) or impressions+revenue (wide) per platform; None if no platform."""
    if "platform" not in df.columns:
        return None
    ms = ["impressions", "revenue"] if wide else ["revenue"]
    return df.groupBy("platform").agg(*[_sum(m, money).alias(m) for m in ms]).orderBy(F.desc("revenue"), "platform")


def platform_share(df: DataFrame, money=raw_sum) -> DataFrame:
    """Percent of revenue and impressions per platform.

    One scan: the totals are a window over the grouped rows, one for each platform.
    """
    g = df.groupBy("platform").agg(_sum("impressions").alias("impressions"), _sum("revenue", money).alias("revenue"))
    every = Window.partitionBy()
    ti, tr = F.sum("impressions").over(every), F.sum("revenue").over(every)
    return g.select(
        "platform", "impressions", "revenue",
        safe_ratio(F.col("impressions"), ti, 100.0).alias("impressions_pct"),
        safe_ratio(F.col("revenue"), tr, 100.0).alias("revenue_pct"),
    )


def date_range(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Min, max and the text 'a to b'."""
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")).withColumn(
        "date_range", F.concat_ws(" to ", F.col("min_date").cast("string"), F.col("max_date").cast("string"))
    )


def distinct_dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """A10: distinct non-null dates, sorted."""
    return df.select(date_col).where(F.col(date_col).isNotNull()).distinct().orderBy(date_col)


def top_campaigns(df: DataFrame, k: int = 10, money=raw_sum) -> DataFrame:
    """L2: first k campaigns by revenue (the limit is the feature: a top-k report)."""
    return campaign_rollup(df, money).limit(k)


def top_performer(df: DataFrame, money=raw_sum) -> DataFrame:
    """L4 + R4: the first campaign by revenue, its guarded ROI and the insight sentence."""
    top = campaign_rollup(df, money).limit(1)
    roi = safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0)
    return top.select(
        "campaign_name", "revenue", "spend",
        roi.alias("roi"),
        F.concat(
            F.lit("Top performer: "), F.col("campaign_name"), F.lit(" generated $"),
            fmt_num("revenue", 0), F.lit(" revenue with "),
            F.regexp_replace(fmt_num(roi, 0), ",", ""), F.lit("% ROI"),
        ).alias("insight"),
    )


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_profile(df: DataFrame) -> DataFrame:
    """One aggregate pass, then a long table (one row per column).

    null count for every column; mean/min/max/sample std for numeric ones.
    """
    dtypes = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c, t in df.dtypes:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if t in NUMERIC_TYPES or t.startswith("decimal"):
            x = F.col(c).cast("double")
            aggs += [
                F.avg(x).alias(f"{c}__mean"), F.min(x).alias(f"{c}__min"),
                F.max(x).alias(f"{c}__max"), F.stddev_samp(x).alias(f"{c}__std"),
            ]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(df.columns):
        numeric = f"{c}__mean" in one.columns
        nul = F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(i).cast("int").alias("ordinal"),
            F.lit(c).alias("column_name"),
            F.lit(dtypes[c]).alias("dtype"),
            F.col("__rows").alias("row_count"),
            F.col(f"{c}__nulls").alias("null_count"),
            (F.col(f"{c}__mean") if numeric else nul).alias("mean"),
            (F.col(f"{c}__min") if numeric else nul).alias("min"),
            (F.col(f"{c}__max") if numeric else nul).alias("max"),
            (F.col(f"{c}__std") if numeric else nul).alias("std"),
        ))
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
