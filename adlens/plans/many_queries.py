"""Registered queries of many reports in one plan: each month of the ad facts is a report of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions.numeric import money_sum, roundn
from adlens.operators import explain as X
from adlens.operators import grouped as G
from adlens.operators.metrics import row_metrics
from adlens.plans import findings_queries as Q
from adlens.plans import sqltext as S
from adlens.plans.catalog import register
from adlens.sources.facts import METRICS, ad_facts

KEY = "report"
_MONTH = "coalesce(strftime(date, '%Y-%m'), 'undated')"


def _month():
    return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("undated"))


def _flagged(spark, d, ids, values=()):
    """(flagged facts with ``ids`` and ``values``, statistics, facts); the facts are joined and scored once."""
    facts = row_metrics(Q.kept_facts(spark, d, ids)).withColumn(KEY, _month())
    stats = G.report_stats(facts, KEY, Q.FEATS)
    return G.flag_reports(facts, KEY, Q.FEATS, stats, Q.CONTAMINATION, places=6, keep=[*ids, *values]), stats, facts


def _findings(spark, d):
    flagged, stats, facts = _flagged(spark, d, Q.TEXT_KEYS, METRICS)  # ratios follow from the metrics, for flagged rows alone
    return X.finding_text(X.explain_findings(row_metrics(flagged), Q.FEATS, G.metric_stats(stats, KEY, Q.FEATS), by=[KEY])), facts


# --------------------------------------------------------------------------- SQL side

_MR = f"SELECT *, {_MONTH} AS report FROM m"
_ENDS = ", ".join(f"{f}({', '.join(f'{g}({Q._clean(c)})' for c in Q.FEATS)}) AS {n}" for f, g, n in (("least", "min", "lo"), ("greatest", "max", "hi")))
_CS = "SELECT report, count(*) AS n, " + _ENDS + ", " + ", ".join(f"avg({Q._clean(c)}) AS {c}__m, stddev_pop({Q._clean(c)}) AS {c}__s" for c in Q.FEATS) + " FROM mr GROUP BY report"
_Z = ", ".join(f"CASE WHEN cs.{c}__s IS NULL OR cs.{c}__s = 0 OR isnan(cs.{c}__s) THEN 0.0 ELSE ({Q._clean('mr.' + c)} - cs.{c}__m) / cs.{c}__s END AS __z_{c}" for c in Q.FEATS)
_ZS = f"SELECT mr.*, cs.n >= 10 AND cs.lo <> cs.hi AS fine, {_Z} FROM mr JOIN cs USING (report)"
_THR = f"SELECT report, quantile_cont(score, {Q.CONTAMINATION}) AS threshold FROM sco WHERE fine GROUP BY report"
_FL = "SELECT sco.*, thr.threshold, coalesce(sco.score < thr.threshold, false) AS is_anomaly FROM sco LEFT JOIN thr USING (report)"


def _stats_sql() -> str:
    parts = []
    for c in Q.FEATS:
        x = f"CAST({c} AS DOUBLE)"
        fin = f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}) THEN {x} END"
        parts.append(
            f"SELECT report, '{c}' AS metric, CASE WHEN pi > 0 AND ni > 0 THEN 'nan'::DOUBLE WHEN pi > 0 THEN 'inf'::DOUBLE WHEN ni > 0 THEN '-inf'::DOUBLE ELSE mm END AS mean, "
            f"CASE WHEN pi > 0 OR ni > 0 THEN 'nan'::DOUBLE ELSE ss END AS std FROM (SELECT report, avg({fin}) AS mm, stddev_pop({fin}) AS ss, "
            f"count_if({x} = 'inf'::DOUBLE) AS pi, count_if({x} = '-inf'::DOUBLE) AS ni FROM mr GROUP BY report) q")
    return "\nUNION ALL\n".join(parts)


_LONG = "\nUNION ALL\n".join(
    f"SELECT report, date, campaign_id, campaign_name, region, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM fl WHERE is_anomaly" for c in Q.FEATS)
_J = Q._J.replace("JOIN st USING (metric)", "JOIN st USING (report, metric)")
_FIND = Q._FIND.replace("SELECT date,", "SELECT report, date,", 1)


def flag_sql(body: str, **more) -> str:
    return S.with_ctes(body, ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, mr=_MR, cs=_CS, zs=_ZS, sco=Q._SCO, thr=_THR, fl=_FL, **more)


def findings_sql(body: str, **more) -> str:
    return flag_sql(body, st=_stats_sql(), long=_LONG, j=_J, fnd=_FIND, f=Q._DESC, **more)


# --------------------------------------------------------------------------- queries

@register("reports_flag", flag_sql("SELECT report, " + ", ".join(Q.KEYS) + f", score, {S.roundn('threshold', 6)} AS threshold, is_anomaly FROM fl"))
def q_reports_flag(spark, d):
    return _flagged(spark, d, Q.KEYS)[0].select(KEY, *Q.KEYS, "score", roundn("threshold", 6).alias("threshold"), "is_anomaly")


@register("reports_findings", findings_sql(
    f"SELECT report, date, campaign_name, metric, severity, value, description, {S.roundn('z', 6)} AS z FROM f"))
def q_reports_findings(spark, d):
    return _findings(spark, d)[0].select(KEY, "date", "campaign_name", "metric", "severity", "value", "description", roundn(F.col("z"), 6).alias("z"))


_SUMS = (f"coalesce({S.isum('impressions')}, 0) AS impressions, coalesce({S.isum('clicks')}, 0) AS clicks, coalesce({S.isum('conversions')}, 0) AS conversions, "
         f"coalesce({S.money_sum('spend')}, 0.0) AS spend, coalesce({S.money_sum('revenue')}, 0.0) AS revenue")
_FACTS = f"SELECT *, {_MONTH} AS report FROM ad_facts"


@register("reports_kpis", S.with_ctes(
    f"SELECT *, {S.safe_ratio('revenue - spend', 'spend', 100.0)} AS roi, {S.safe_ratio('clicks', 'impressions', 100.0)} AS ctr, "
    f"{S.safe_ratio('conversions', 'clicks', 100.0)} AS conversion_rate FROM (SELECT report, {_SUMS}, count(*) AS total_records, count(DISTINCT campaign_name) AS campaign_count, "
    "concat_ws(' to ', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)) AS reporting_period FROM fr GROUP BY report) t", ad_facts=S.AD_FACTS_SQL, fr=_FACTS))
def q_reports_kpis(spark, d):
    return G.kpis_by_report(ad_facts(spark, d).withColumn(KEY, _month()), KEY, money_sum)


@register("reports_campaigns", S.with_ctes(
    f"SELECT *, {S.round2(S.safe_ratio('clicks', 'impressions', 100.0))} AS ctr, {S.roundn(S.safe_ratio('revenue - spend', 'spend', 100.0), 1)} AS roi, "
    "CAST(row_number() OVER (PARTITION BY report ORDER BY revenue DESC, campaign_name) AS INTEGER) AS place "
    f"FROM (SELECT report, campaign_name, {_SUMS} FROM fr GROUP BY report, campaign_name) t", ad_facts=S.AD_FACTS_SQL, fr=_FACTS))
def q_reports_campaigns(spark, d):
    return G.campaigns_by_report(ad_facts(spark, d).withColumn(KEY, _month()), KEY, money_sum)


_PLACED = f"SELECT *, row_number() OVER (PARTITION BY report {Q._TOP_ORDER}) AS place FROM f"


@register("reports_text", findings_sql(
    "SELECT r.report, coalesce(b.n, 0) AS n, CASE WHEN b.n > 0 THEN concat('**', CAST(b.n AS VARCHAR), ' anomalies detected:**', chr(10), chr(10), b.bullets, chr(10)) "
    f"ELSE '{Q.NO_FINDINGS_SENTENCE}' END AS text FROM (SELECT DISTINCT report FROM mr) r LEFT JOIN "
    "(SELECT report, count(*) AS n, string_agg(concat('- ', description), chr(10) ORDER BY place) FILTER (WHERE place <= 5) AS bullets FROM pl GROUP BY report) b USING (report)",
    pl=_PLACED))
def q_reports_text(spark, d):
    findings, facts = _findings(spark, d)
    return G.texts_by_report(findings, facts.select(KEY).distinct(), KEY)
