"""Registered queries: a Spark plan and, where SQL can state it, a DuckDB oracle.

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full; limits appear only where the limit is the feature (top-k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.numeric import money_sum, round2, roundn, snap_round
from adlens.operators import metrics as M
from adlens.operators import rollups as A
from adlens.operators import series as T
from adlens.plans import sqltext as S
from adlens.sources.facts import ad_facts

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def facts_sql(body: str, **more: str) -> str:
    return S.with_ctes(body, ad_facts=S.AD_FACTS_SQL, **more)


def metrics_sql(body: str, **more: str) -> str:
    return S.with_ctes(body, ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, **more)


# --------------------------------------------------------------------------- row metrics

@register("row_metrics", metrics_sql(
    "SELECT l_orderkey, l_linenumber, date, campaign_id, ctr, conversion_rate, cpa, roi, roas FROM m"))
def q_row_metrics(spark, d):
    return M.row_metrics(ad_facts(spark, d)).select(
        "l_orderkey", "l_linenumber", "date", "campaign_id", "ctr", "conversion_rate", "cpa", "roi", "roas")


_GUARD_SQL = facts_sql(
    "SELECT f.l_orderkey, f.l_linenumber, f.campaign_id, "
    f"CASE WHEN t.ti > 0 THEN {S.round2('coalesce(CASE WHEN isnan(x.ctr0) THEN 0.0 ELSE x.ctr0 END, NULL)')} ELSE 0.0 END AS ctr, "
    f"CASE WHEN t.ts > 0 THEN {S.round2('CASE WHEN isnan(x.roi0) THEN 0.0 ELSE x.roi0 END')} ELSE 0.0 END AS roi "
    "FROM ad_facts f CROSS JOIN (SELECT sum(impressions) AS ti, sum(spend) AS ts FROM ad_facts) t "
    f"CROSS JOIN LATERAL (SELECT {S.fdiv('f.clicks', 'f.impressions')} * 100 AS ctr0, "
    f"{S.fdiv('f.revenue - f.spend', 'f.spend')} * 100 AS roi0) x"
)


@register("row_metrics_guarded", _GUARD_SQL)
def q_row_metrics_guarded(spark, d):
    return M.row_metrics(ad_facts(spark, d), zero_mode="guarded").select(
        "l_orderkey", "l_linenumber", "campaign_id", "ctr", "roi")


# --------------------------------------------------------------------------- totals and rollups

@register("kpi_totals", facts_sql(
    "SELECT impressions, clicks, conversions, revenue, spend, "
    f"{S.safe_ratio('revenue - spend', 'spend', 100.0)} AS roi, "
    f"{S.safe_ratio('clicks', 'impressions', 100.0)} AS ctr, "
    f"{S.safe_ratio('conversions', 'clicks', 100.0)} AS conversion_rate "
    f"FROM (SELECT coalesce({S.isum('impressions')}, 0) AS impressions, coalesce({S.isum('clicks')}, 0) AS clicks, "
    f"coalesce({S.isum('conversions')}, 0) AS conversions, coalesce({S.money_sum('revenue')}, 0.0) AS revenue, "
    f"coalesce({S.money_sum('spend')}, 0.0) AS spend FROM ad_facts) t"))
def q_kpi_totals(spark, d):
    return A.kpi_totals(ad_facts(spark, d), money=money_sum)


_SUMS5 = (f"{S.isum('impressions')} AS impressions, {S.isum('clicks')} AS clicks, "
          f"{S.isum('conversions')} AS conversions, {S.money_sum('spend')} AS spend, "
          f"{S.money_sum('revenue')} AS revenue")


@register("daily_metrics", facts_sql(f"SELECT date, {_SUMS5} FROM ad_facts GROUP BY date"))
def q_daily_metrics(spark, d):
    return A.aggregate_by_date(ad_facts(spark, d), money=money_sum)


@register("campaign_by_id", facts_sql(
    f"SELECT campaign_id, campaign_name, {_SUMS5} FROM ad_facts GROUP BY campaign_id, campaign_name"))
def q_campaign_by_id(spark, d):
    return A.aggregate_by_campaign(ad_facts(spark, d), money=money_sum)


@register("campaign_summary", facts_sql(
    "SELECT campaign_name, impressions, clicks, conversions, spend, revenue, "
    f"{S.round2(S.safe_ratio('clicks', 'impressions', 100.0))} AS ctr, "
    f"{S.roundn(S.safe_ratio('revenue - spend', 'spend', 100.0), 1)} AS roi "
    f"FROM (SELECT campaign_name, coalesce({S.isum('impressions')}, 0) AS impressions, "
    f"coalesce({S.isum('clicks')}, 0) AS clicks, coalesce({S.isum('conversions')}, 0) AS conversions, "
    f"coalesce({S.money_sum('spend')}, 0.0) AS spend, coalesce({S.money_sum('revenue')}, 0.0) AS revenue "
    "FROM ad_facts GROUP BY campaign_name) g"))
def q_campaign_summary(spark, d):
    return A.campaign_summary(ad_facts(spark, d), money=money_sum)


_ROLLUP = (f"SELECT campaign_name, {S.isum('impressions')} AS impressions, {S.isum('clicks')} AS clicks, "
           f"{S.money_sum('revenue')} AS revenue, {S.money_sum('spend')} AS spend FROM ad_facts GROUP BY campaign_name")


@register("campaign_rollup", facts_sql(_ROLLUP))
def q_campaign_rollup(spark, d):
    return A.campaign_rollup(ad_facts(spark, d), money=money_sum)


@register("campaign_compare", facts_sql(
    f"SELECT campaign_name, {S.money_sum('spend')} AS spend FROM ad_facts GROUP BY campaign_name"))
def q_campaign_compare(spark, d):
    return A.campaign_compare(ad_facts(spark, d), "spend", money=money_sum)


@register("platform_rollup", facts_sql(
    f"SELECT platform, {S.isum('impressions')} AS impressions, {S.money_sum('revenue')} AS revenue "
    "FROM ad_facts GROUP BY platform"))
def q_platform_rollup(spark, d):
    return A.platform_rollup(ad_facts(spark, d), wide=True, money=money_sum)


@register("platform_share", facts_sql(
    "SELECT platform, impressions, revenue, "
    f"{S.roundn(S.safe_ratio('impressions', 'ti', 100.0), 4)} AS impressions_pct, "
    f"{S.roundn(S.safe_ratio('revenue', 'tr', 100.0), 4)} AS revenue_pct "
    f"FROM g CROSS JOIN (SELECT sum(impressions) AS ti, sum(revenue) AS tr FROM g) t",
    g=f"SELECT platform, {S.isum('impressions')} AS impressions, {S.money_sum('revenue')} AS revenue "
      "FROM ad_facts GROUP BY platform"))
def q_platform_share(spark, d):
    share = A.platform_share(ad_facts(spark, d), money=money_sum)
    return share.withColumns({c: roundn(c, 4) for c in ("impressions_pct", "revenue_pct")})


@register("date_range", facts_sql(
    "SELECT min(date) AS min_date, max(date) AS max_date, "
    "concat_ws(' to ', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)) AS date_range FROM ad_facts"))
def q_date_range(spark, d):
    return A.date_range(ad_facts(spark, d))


@register("distinct_dates", facts_sql("SELECT DISTINCT date FROM ad_facts WHERE date IS NOT NULL"))
def q_distinct_dates(spark, d):
    return A.distinct_dates(ad_facts(spark, d))


@register("top_campaigns", facts_sql(f"SELECT * FROM ({_ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 10"))
def q_top_campaigns(spark, d):
    return A.top_campaigns(ad_facts(spark, d), 10, money=money_sum)


@register("top_performer", facts_sql(
    "SELECT campaign_name, revenue, spend, roi, "
    f"concat('Top performer: ', campaign_name, ' generated $', {S.fmt_num('revenue', 0)}, "
    f"' revenue with ', replace({S.fmt_num('roi', 0)}, ',', ''), '% ROI') AS insight "
    f"FROM (SELECT *, {S.safe_ratio('revenue - spend', 'spend', 100.0)} AS roi FROM "
    f"(SELECT * FROM ({_ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 1) t) u"))
def q_top_performer(spark, d):
    return A.top_performer(ad_facts(spark, d), money=money_sum)


# --------------------------------------------------------------------------- daily series

_DAILY_RS = f"SELECT date, {S.money_sum('revenue')} AS revenue, {S.money_sum('spend')} AS spend FROM ad_facts GROUP BY date"
_DAILY_ROI = (f"SELECT date, revenue, spend, {S.round2(S.safe_ratio('revenue - spend', 'spend', 100.0))} AS roi "
              f"FROM ({_DAILY_RS}) d")


@register("daily_roi", facts_sql(_DAILY_ROI))
def q_daily_roi(spark, d):
    return T.daily_roi(ad_facts(spark, d), money=money_sum).withColumn("roi", round2("roi"))


@register("daily_vs_avg", facts_sql(
    f"SELECT d.date, d.revenue, d.spend, {S.round2('d.roi')} AS roi, {S.snap_round('a.m', 6)} AS avg_roi, d.roi > a.m AS above_avg FROM dr d "
    "CROSS JOIN (SELECT avg(roi) AS m FROM dr) a",
    dr=f"SELECT date, revenue, spend, {S.safe_ratio('revenue - spend', 'spend', 100.0)} AS roi FROM ({_DAILY_RS}) d"))
def q_daily_vs_avg(spark, d):
    got = T.daily_vs_avg(ad_facts(spark, d), money=money_sum)
    return got.withColumns({"roi": round2("roi"), "avg_roi": snap_round("avg_roi", 6)})


@register("daily_vs_avg_clicks", facts_sql(
    f"SELECT date, clicks, {S.snap_round('avg(clicks) OVER ()', 6)} AS avg_clicks, clicks > avg(clicks) OVER () AS above_avg "
    f"FROM (SELECT date, {S.isum('clicks')} AS clicks FROM ad_facts GROUP BY date) g"))
def q_daily_vs_avg_clicks(spark, d):
    return T.daily_vs_avg(ad_facts(spark, d), "clicks").withColumn("avg_clicks", snap_round("avg_clicks", 6))


@register("daily_roi_wide", facts_sql(
    f"SELECT date, revenue, spend, {S.round2(S.fdiv('revenue - spend', 'spend') + ' * 100')} AS roi FROM ({_DAILY_RS}) d"))
def q_daily_roi_wide(spark, d):
    return T.daily_roi(ad_facts(spark, d), guarded=False, money=money_sum).withColumn("roi", round2("roi"))


def _dod_sql(part: str, keys: str) -> str:
    chg = S.roundn(S.fdiv("revenue - prev", "prev") + " * 100", 4)
    return (
        f"SELECT {keys}, revenue, change_pct, CASE WHEN coalesce(CASE WHEN isnan(change_pct) THEN 0.0 "
        "ELSE change_pct END, 0.0) >= 0 THEN 'good' ELSE 'bad' END AS sign FROM ("
        f"SELECT {keys}, revenue, {chg} AS change_pct FROM ("
        f"SELECT {keys}, revenue, lag(revenue, 1) OVER ({part} ORDER BY date) AS prev FROM ("
        f"SELECT {keys}, {S.money_sum('revenue')} AS revenue FROM ad_facts GROUP BY {keys}) g) l) c"
    )


@register("day_over_day", facts_sql(_dod_sql("", "date")))
def q_day_over_day(spark, d):
    return T.day_over_day(ad_facts(spark, d), "revenue", money=money_sum).withColumn("change_pct", roundn("change_pct", 4))


@register("campaign_day_over_day", facts_sql(_dod_sql("PARTITION BY campaign_name", "campaign_name, date")))
def q_campaign_day_over_day(spark, d):
    return T.campaign_day_over_day(ad_facts(spark, d), "revenue", money=money_sum).withColumn("change_pct", roundn("change_pct", 4))


@register("metric_trend", facts_sql(f"SELECT date, {S.isum('clicks')} AS clicks FROM ad_facts GROUP BY date"))
def q_metric_trend(spark, d):
    return T.metric_trend(ad_facts(spark, d), "clicks")


@register("axis_labels", facts_sql(
    "SELECT date, CAST(pos AS BIGINT) AS pos, strftime(date, '%m-%d') AS label FROM ("
    "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, "
    "greatest(1, floor(count(*) OVER () / 5)) AS step FROM (SELECT DISTINCT date FROM ad_facts "
    "WHERE date IS NOT NULL) d) x WHERE pos % step = 0"))
def q_axis_labels(spark, d):
    return T.axis_labels(ad_facts(spark, d))


# --------------------------------------------------------------------------- profile

_PROFILE_COLS = [
    ("l_orderkey", "bigint", True), ("l_linenumber", "int", True), ("date", "date", False),
    ("campaign_id", "string", False), ("campaign_name", "string", False), ("impressions", "bigint", True),
    ("clicks", "bigint", True), ("conversions", "bigint", True), ("spend", "double", True),
    ("revenue", "double", True), ("region", "string", False), ("platform", "string", False),
]


def _profile_sql(cols=None, source: str = "ad_facts", wrap=None) -> str:
    parts = []
    for i, (c, t, num) in enumerate(cols or _PROFILE_COLS):
        x = f"CAST({c} AS DOUBLE)"
        stats = (
            f"{S.snap_round(f'avg({x})', 6)}, min({x}), max({x}), {S.snap_round(f'stddev_samp({x})', 6)}"
            if num else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        )
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS dtype, count(*) AS row_count, "
            f"count_if({c} IS NULL) AS null_count, {stats} FROM {source}"
        )
    body = "\nUNION ALL\n".join(parts)
    sql = ("SELECT ordinal, column_name, dtype, row_count, null_count, c5 AS mean, c6 AS min, c7 AS max, c8 AS std "
           f"FROM ({body}) p(ordinal, column_name, dtype, row_count, null_count, c5, c6, c7, c8)")
    return (wrap or facts_sql)(sql)


def _rounded(profile: DataFrame) -> DataFrame:
    """Means and deviations to six places, as sums differ in their last bits with the order of rows."""
    return profile.withColumns({c: snap_round(F.col(c), 6) for c in ("mean", "std")})


@register("column_profile", _profile_sql())
def q_column_profile(spark, d):
    return _rounded(A.column_profile(ad_facts(spark, d)))


_EVENT_COLS = [
    ("event_id", "bigint", True), ("ts", "timestamp_ntz", False), ("user_id", "bigint", True),
    ("event_type", "string", False), ("value", "double", True), ("props", "string", False),
]


@register("events_profile", _profile_sql(_EVENT_COLS, "events", wrap=lambda q: q))
def q_events_profile(spark, d):
    # S11 on a second table: the profile is generic over any schema
    return _rounded(A.column_profile(spark.read.parquet(f"{d}/events.parquet")))


def _load_all() -> None:
    # modules that register more queries (imported late: they use ``register``)
    from adlens.plans import file_queries, findings_queries, many_queries, normalize_queries, report_queries, stream_queries  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
