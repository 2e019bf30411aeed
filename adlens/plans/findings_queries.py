"""Registered queries for the flag, the findings and the report tables.

The flag used by oracle queries is the deterministic z-sum score with the
exact contamination quantile; the isolation-forest queries are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions.numeric import money_sum, round2, roundn, snap_round
from adlens.functions.text import METRIC_DISPLAY_NAMES, NO_FINDINGS_SENTENCE
from adlens.operators import explain as X
from adlens.operators import forms as O
from adlens.operators import report as R
from adlens.operators.detect import detect
from adlens.operators.features import (
    DEFAULT_FEATURES,
    all_stats,
    feature_matrix,
    feature_scaled,
    feature_stats,
    flag_by_contamination,
    zsum_score,
)
from adlens.operators.metrics import row_metrics
from adlens.operators.rows import one_row, stored
from adlens.operators.rollups import aggregate_by_date, kpi_totals
from adlens.plans import sqltext as S
from adlens.plans.catalog import register
from adlens.sources.facts import METRICS, ad_facts

FEATS = DEFAULT_FEATURES
KEYS = ["l_orderkey", "l_linenumber", "date", "campaign_id"]
TEXT_KEYS = ["date", "campaign_id", "campaign_name", "region"]
CONTAMINATION = 0.1

# --------------------------------------------------------------------------- Spark side


def metric_facts(spark, d):
    return row_metrics(ad_facts(spark, d))


def kept_facts(spark, d, ids):
    """``ids`` and the metrics of the facts, joined once: statistics, quantile and output are passes over them."""
    return stored(ad_facts(spark, d).select(*ids, *METRICS), "facts")


def flagged_with_stats(facts):
    """(flagged facts, statistics of the features): one pass for all statistics, one for the quantile."""
    facts = row_metrics(facts)
    row, stats = all_stats(facts, FEATS, guarded=False)
    fl = flag_by_contamination(zsum_score(facts, FEATS, places=6, stats=row), CONTAMINATION)
    return fl.withColumn("threshold", roundn("threshold", 6)), stats


def flagged_facts(spark, d, ids):
    """The flag alone needs the statistics of the cleaned features only."""
    fl = flag_by_contamination(zsum_score(row_metrics(kept_facts(spark, d, ids)), FEATS, places=6), CONTAMINATION)
    return fl.withColumn("threshold", roundn("threshold", 6))


def findings(spark, d, facts=None):
    """``facts``: those of ``kept_facts`` with ``TEXT_KEYS``, where a query has them already."""
    fl, stats = flagged_with_stats(kept_facts(spark, d, TEXT_KEYS) if facts is None else facts)
    return X.finding_text(X.explain_findings(fl, FEATS, stats))


# --------------------------------------------------------------------------- SQL side

def _clean(c):
    return S.finite_or_zero(c)


_CS = "SELECT " + ", ".join(
    f"avg({_clean(c)}) AS {c}__m, stddev_pop({_clean(c)}) AS {c}__s" for c in FEATS) + " FROM m"
_Z = ", ".join(
    f"CASE WHEN cs.{c}__s IS NULL OR cs.{c}__s = 0 OR isnan(cs.{c}__s) THEN 0.0 "
    f"ELSE ({_clean('m.' + c)} - cs.{c}__m) / cs.{c}__s END AS __z_{c}" for c in FEATS)
_ZS = f"SELECT m.*, {_Z} FROM m CROSS JOIN cs"
_SCORE = S.roundn("-(" + " + ".join(f"__z_{c} * __z_{c}" for c in FEATS) + ")", 6)
_SCO = f"SELECT *, {_SCORE} AS score FROM zs"
_FL = (f"SELECT sco.*, {S.roundn('thr.t', 6)} AS threshold, coalesce(sco.score < thr.t, false) AS is_anomaly "
       f"FROM sco CROSS JOIN (SELECT quantile_cont(score, {CONTAMINATION}) AS t FROM sco) thr")


def _stats_sql() -> str:
    parts = []
    for i, c in enumerate(FEATS):
        x = f"CAST({c} AS DOUBLE)"
        fin = f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}) THEN {x} END"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS metric, "
            "CASE WHEN pi > 0 AND ni > 0 THEN 'nan'::DOUBLE WHEN pi > 0 THEN 'inf'::DOUBLE "
            "WHEN ni > 0 THEN '-inf'::DOUBLE ELSE mm END AS mean, "
            "CASE WHEN pi > 0 OR ni > 0 THEN 'nan'::DOUBLE ELSE ss END AS std, lo AS min, hi AS max FROM ("
            f"SELECT avg({fin}) AS mm, stddev_pop({fin}) AS ss, min(CASE WHEN NOT isnan({x}) THEN {x} END) AS lo, "
            f"max(CASE WHEN NOT isnan({x}) THEN {x} END) AS hi, count_if({x} = 'inf'::DOUBLE) AS pi, "
            f"count_if({x} = '-inf'::DOUBLE) AS ni FROM m) q{i}"
        )
    return "\nUNION ALL\n".join(parts)


_LONG = "\nUNION ALL\n".join(
    f"SELECT date, campaign_id, campaign_name, region, '{c}' AS metric, CAST({c} AS DOUBLE) AS value "
    "FROM fl WHERE is_anomaly" for c in FEATS)
_J = (
    "SELECT l.*, st.mean, st.std, abs(l.value - st.mean) / st.std AS z FROM long l JOIN st USING (metric) "
    "WHERE l.value IS NOT NULL AND NOT isnan(l.value) AND st.std IS NOT NULL AND NOT isnan(st.std) "
    "AND NOT isinf(st.std) AND st.std > 0 AND st.mean IS NOT NULL AND NOT isnan(st.mean) AND NOT isinf(st.mean)"
)
_DISPLAY = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_DISPLAY_NAMES.items()) + \
    " ELSE metric END"
_FIND = (
    "SELECT date, campaign_id, campaign_name, region, metric, value AS raw_value, z, "
    "CASE WHEN z > 3 THEN 'high' WHEN z > 2.5 THEN 'medium' ELSE 'low' END AS severity, "
    "CASE WHEN value < mean THEN 'below' ELSE 'above' END AS direction, "
    "CASE WHEN mean != 0 THEN (value - mean) / mean * 100 ELSE 0.0 END AS pct_diff, "
    f"{S.round2('mean - 2 * std')} AS expected_lo, {S.round2('mean + 2 * std')} AS expected_hi, "
    f"{S.round2('value')} AS value FROM j WHERE NOT isnan(z) AND z > 2"
)
_DESC = (
    "SELECT *, concat(CASE WHEN direction = 'below' THEN concat(" + _DISPLAY + ", ' dropped ', "
    + S.fmt_plain("abs(pct_diff)", 1) + ", '% below average') ELSE concat(" + _DISPLAY + ", ' spiked ', "
    + S.fmt_plain("pct_diff", 1) + ", '% above average') END, ' for ', coalesce(campaign_name, 'Unknown Campaign'), "
    "' on ', coalesce(CAST(date AS VARCHAR), 'Unknown Date'), "
    "CASE WHEN coalesce(region, '') != '' THEN concat(' in ', region) ELSE '' END) AS description FROM fnd"
)


def flag_sql(body: str, **more) -> str:
    return S.with_ctes(body, ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, cs=_CS, zs=_ZS, sco=_SCO, fl=_FL, **more)


def findings_sql(body: str, **more) -> str:
    return flag_sql(body, st=_stats_sql(), long=_LONG, j=_J, fnd=_FIND, f=_DESC, **more)


# --------------------------------------------------------------------------- queries

@register("feature_matrix", S.with_ctes(
    "SELECT " + ", ".join(KEYS) + ", " + ", ".join(f"{_clean(c)} AS {c}" for c in FEATS) + " FROM m",
    ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL))
def q_feature_matrix(spark, d):
    return feature_matrix(metric_facts(spark, d), FEATS, KEYS)


@register("feature_stats", S.with_ctes(
    f"SELECT ordinal, metric, {S.snap_round('mean', 6)} AS mean, {S.snap_round('std', 6)} AS std, min, max FROM st",
    ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, st=_stats_sql()))
def q_feature_stats(spark, d):
    st = feature_stats(metric_facts(spark, d), FEATS)
    return st.withColumns({"mean": snap_round(F.col("mean"), 6), "std": snap_round(F.col("std"), 6)})


@register("feature_scaled", S.with_ctes(
    "SELECT " + ", ".join(KEYS) + ", " + ", ".join(f"{S.roundn(f'__z_{c}', 6)} AS {c}" for c in FEATS) + " FROM zs",
    ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, cs=_CS, zs=_ZS))
def q_feature_scaled(spark, d):
    return feature_scaled(metric_facts(spark, d), FEATS, KEYS).withColumns({c: roundn(c, 6) for c in FEATS})


@register("contamination_flag", flag_sql("SELECT " + ", ".join(KEYS) + ", score, threshold, is_anomaly FROM fl"))
def q_contamination_flag(spark, d):
    return flagged_facts(spark, d, KEYS).select(*KEYS, "score", "threshold", "is_anomaly")


_EXPLAIN_COLS = ["date", "campaign_id", "campaign_name", "region", "metric", "value", "severity", "direction",
                 "expected_lo", "expected_hi"]


@register("anomaly_explain", findings_sql(
    "SELECT " + ", ".join(_EXPLAIN_COLS) + f", {S.roundn('z', 6)} AS z, {S.roundn('pct_diff', 4)} AS pct_diff FROM f"))
def q_anomaly_explain(spark, d):
    return findings(spark, d).select(*_EXPLAIN_COLS, roundn(F.col("z"), 6).alias("z"),
                                     roundn(F.col("pct_diff"), 4).alias("pct_diff"))


@register("anomaly_text", findings_sql("SELECT date, campaign_name, metric, severity, description FROM f"))
def q_anomaly_text(spark, d):
    return findings(spark, d).select("date", "campaign_name", "metric", "severity", "description")


@register("row_alerts", flag_sql(
    "SELECT campaign_name, date, coalesce(region, 'Unknown') AS region, impressions, "
    "CASE WHEN impressions < 50000 THEN 'high' ELSE 'medium' END AS severity, "
    "concat(coalesce(campaign_name, 'Unknown Campaign'), ' had unusual activity on ', coalesce(CAST(date AS VARCHAR), 'Unknown Date'), "
    "' in ', coalesce(region, 'Unknown')) AS description, "
    "concat(coalesce(campaign_name, 'Unknown Campaign'), ' - unusual metrics on ', coalesce(CAST(date AS VARCHAR), 'Unknown Date')) AS summary "
    "FROM fl WHERE is_anomaly"))
def q_row_alerts(spark, d):
    return X.row_alerts(flagged_facts(spark, d, TEXT_KEYS))


_IDX_ORDER = ["date", "campaign_id", "l_orderkey", "l_linenumber", "impressions", "clicks", "spend", "revenue",
              "score"]


@register("flagged_row_index", flag_sql(
    "SELECT l_orderkey, l_linenumber, date, campaign_id, score, row_number() OVER (ORDER BY "
    + ", ".join(_IDX_ORDER) + ") - 1 AS row_index FROM fl WHERE is_anomaly"))
def q_flagged_row_index(spark, d):
    return X.flagged_row_index(flagged_facts(spark, d, KEYS), _IDX_ORDER).select(
        "l_orderkey", "l_linenumber", "date", "campaign_id", "score", "row_index")


@register("anomaly_summary", findings_sql(
    "SELECT 'total' AS dimension, 'all' AS key, count(*) AS n FROM f "
    "UNION ALL SELECT 'severity', s.key, coalesce(c.n, 0) FROM (VALUES ('high'), ('medium'), ('low')) s(key) "
    "LEFT JOIN (SELECT severity, count(*) AS n FROM f GROUP BY severity) c ON s.key = c.severity "
    "UNION ALL SELECT 'metric', metric, count(*) FROM f GROUP BY metric "
    "UNION ALL SELECT 'campaign', campaign_name, count(*) FROM f GROUP BY campaign_name"))
def q_anomaly_summary(spark, d):
    return X.anomaly_summary(findings(spark, d))


_TOP_ORDER = "ORDER BY z DESC, date, campaign_name, metric, value"


@register("top_anomalies", findings_sql(
    f"SELECT date, campaign_name, metric, severity, value, substr(description, 1, 70) AS alert FROM f {_TOP_ORDER} "
    "LIMIT 10"))
def q_top_anomalies(spark, d):
    return X.top_findings(findings(spark, d), 10, 70)


@register("findings_text", findings_sql(
    f"SELECT n, CASE WHEN n = 0 THEN '{NO_FINDINGS_SENTENCE}' ELSE concat('**', CAST(n AS VARCHAR), "
    "' anomalies detected:**', chr(10), chr(10), b.bullets, chr(10)) END AS text "
    "FROM (SELECT count(*) AS n FROM f) a CROSS JOIN (SELECT string_agg(concat('- ', description), chr(10) "
    f"{_TOP_ORDER}) AS bullets FROM (SELECT * FROM f {_TOP_ORDER} LIMIT 5) t) b"))
def q_findings_text(spark, d):
    return X.findings_text(findings(spark, d), 5)


@register("findings_short", findings_sql(
    "SELECT n, CASE WHEN n = 0 THEN 'No anomalies detected.' ELSE concat('**', CAST(n AS VARCHAR), "
    "' anomalies detected:**', chr(10), chr(10), b.bullets, chr(10)) END AS text "
    "FROM (SELECT count(*) AS n FROM f) a CROSS JOIN (SELECT string_agg(concat('- ', description), chr(10) "
    f"{_TOP_ORDER}) AS bullets FROM (SELECT * FROM f {_TOP_ORDER} LIMIT 5) t) b"))
def q_findings_short(spark, d):
    return O.findings_short(findings(spark, d), 5)


@register("anomaly_overlay", findings_sql(
    "SELECT d.date, d.impressions, coalesce(mk.m, false) AS is_marked FROM "
    f"(SELECT date, {S.isum('impressions')} AS impressions FROM ad_facts GROUP BY date) d LEFT JOIN "
    "(SELECT DISTINCT date, true AS m FROM f WHERE metric = 'impressions') mk ON d.date = mk.date"))
def q_anomaly_overlay(spark, d):
    facts = kept_facts(spark, d, TEXT_KEYS)
    return X.overlay(aggregate_by_date(facts, metrics=["impressions"]), findings(spark, d, facts), "impressions")


@register("affected_campaigns", findings_sql("SELECT DISTINCT campaign_name FROM f"))
def q_affected_campaigns(spark, d):
    return findings(spark, d).select("campaign_name").distinct()


def facts_totals(facts):
    """One row: totals, records, the period, and the campaigns, whose names are counted in a pass of their own (beside
    sums, a distinct count has every name carry all sums through the shuffle)."""
    k = kpi_totals(
        facts, F.count(F.lit(1)).alias("total_records"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("reporting_period"),
        money=money_sum,
    )
    return one_row(k, facts.agg(F.count_distinct("campaign_name").alias("campaign_count")))


def _context(spark, d):
    facts = kept_facts(spark, d, TEXT_KEYS)
    k = facts_totals(facts)
    f = stored(findings(spark, d, facts).select("date", "campaign_name", "metric", "value", "z", "severity", "description"), "findings")
    fa = f.agg(F.count(F.lit(1)).alias("total_anomalies"),
               F.count_if(F.col("severity") == "high").alias("high_severity"),
               F.count_distinct("campaign_name").alias("affected_campaigns"))
    return one_row(k, fa, *O.context_lists(facts, f, money=money_sum)).select(
        "reporting_period", "total_records",
        F.col("impressions").alias("total_impressions"), F.col("clicks").alias("total_clicks"),
        F.col("conversions").alias("total_conversions"), F.col("spend").alias("total_spend"),
        F.col("revenue").alias("total_revenue"), F.col("ctr").alias("average_ctr"),
        F.col("roi").alias("average_roi"), "campaign_count", "total_anomalies", "high_severity",
        "affected_campaigns", "affected_campaign_names", "top_campaigns", "anomaly_details",
    )


_KPI_SQL = (
    "SELECT impressions, clicks, conversions, revenue, spend, "
    f"{S.safe_ratio('revenue - spend', 'spend', 100.0)} AS roi, "
    f"{S.safe_ratio('clicks', 'impressions', 100.0)} AS ctr, "
    f"{S.safe_ratio('conversions', 'clicks', 100.0)} AS conversion_rate "
    f"FROM (SELECT coalesce({S.isum('impressions')}, 0) AS impressions, coalesce({S.isum('clicks')}, 0) AS clicks, "
    f"coalesce({S.isum('conversions')}, 0) AS conversions, coalesce({S.money_sum('revenue')}, 0.0) AS revenue, "
    f"coalesce({S.money_sum('spend')}, 0.0) AS spend FROM ad_facts) t"
)


_ROLLUP = (f"SELECT campaign_name, {S.isum('impressions')} AS impressions, {S.isum('clicks')} AS clicks, "
           f"{S.money_sum('revenue')} AS revenue, {S.money_sum('spend')} AS spend FROM ad_facts GROUP BY campaign_name")
_TOP_CAMPAIGNS = (
    f"(SELECT coalesce(string_agg(concat(coalesce(campaign_name, 'Unknown Campaign'), ': $', {S.fmt_num('revenue', 2)}, ', ROI ', {S.fmt_plain('roi', 1)}, '%'), '|' "
    f"ORDER BY revenue DESC, campaign_name), '') FROM (SELECT campaign_name, coalesce(revenue, 0.0) AS revenue, {S.roundn(S.safe_ratio('revenue - spend', 'spend', 100.0), 1)} AS roi "
    f"FROM ({_ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 10) t)"
)


@register("anomaly_context", findings_sql(
    "SELECT b.reporting_period, b.total_records, k.impressions AS total_impressions, k.clicks AS total_clicks, "
    "k.conversions AS total_conversions, k.spend AS total_spend, k.revenue AS total_revenue, "
    "k.ctr AS average_ctr, k.roi AS average_roi, b.campaign_count, fa.total_anomalies, fa.high_severity, "
    "fa.affected_campaigns, (SELECT coalesce(string_agg(campaign_name, '|' ORDER BY campaign_name), '') FROM (SELECT DISTINCT campaign_name FROM f) q) "
    f"AS affected_campaign_names, {_TOP_CAMPAIGNS} AS top_campaigns, "
    f"(SELECT coalesce(string_agg(description, '|' {_TOP_ORDER}), '') FROM (SELECT * FROM f {_TOP_ORDER} LIMIT 10) t) AS anomaly_details "
    "FROM (SELECT count(*) AS total_records, count(DISTINCT campaign_name) AS campaign_count, "
    "concat_ws(' to ', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)) AS reporting_period FROM ad_facts) b "
    "CROSS JOIN kp k CROSS JOIN (SELECT count(*) AS total_anomalies, count_if(severity = 'high') AS high_severity, "
    "count(DISTINCT campaign_name) AS affected_campaigns FROM f) fa", kp=_KPI_SQL))
def q_anomaly_context(spark, d):
    return _context(spark, d)


@register("isolation_forest")
def q_isolation_forest(spark, d):
    # rows-only: another generator gives other trees, so only properties can be compared
    return detect(row_metrics(kept_facts(spark, d, KEYS)), "iforest", FEATS, CONTAMINATION, n_trees=100).select(
        *KEYS, "anomaly_score", "is_anomaly")


# ---- a saved model: four trees of seven nodes, (tree, node, feature, split, left, right, size, depth) by rule ----
_MODEL_FEATS = ["impressions", "clicks", "spend", "revenue"]
_SPLITS = {"impressions": [20_000.0, 45_000.0, 80_000.0], "clicks": [400.0, 900.0, 1_500.0], "spend": [300.0, 900.0, 2_000.0], "revenue": [10_000.0, 30_000.0, 60_000.0]}


def saved_nodes() -> list[tuple]:
    out = []
    for tree in range(4):
        for node in range(7):
            f = (tree + node) % 4
            inner = node < 3
            out.append((tree, node, f if inner else -1, _SPLITS[_MODEL_FEATS[f]][(tree + node) % 3] if inner else 0.0, 2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1,
                        [64, 40, 24, 1, 39, 2, 22][node], [0, 1, 1, 2, 2, 2, 2][node]))
    return out


_NODES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {n}, {'NULL' if f < 0 else repr(_MODEL_FEATS[f])}, CAST({s} AS DOUBLE), {a}, {b}, CAST({z} AS DOUBLE), {d})" for t, n, f, s, a, b, z, d in saved_nodes()
) + ") v(tree, node, feature, split, lft, rgt, size, depth)"
_PATH = "CASE WHEN {0} <= 1 THEN 0.0 WHEN {0} = 2 THEN 1.0 ELSE 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} END"


@register("forest_scores", S.with_ctes(
    "SELECT l_orderkey, l_linenumber, date, campaign_id, " + S.roundn("pow(2.0, -avg(depth + " + _PATH.format("size") + ") / " + _PATH.format("64.0") + ")", 6) + " AS iso_score "
    "FROM (SELECT m.l_orderkey, m.l_linenumber, m.date, m.campaign_id, c.size, c.depth FROM c JOIN nd p ON p.tree = c.tree AND (p.lft = c.node OR p.rgt = c.node) "
    "JOIN nd r ON r.tree = c.tree AND r.node = 0, m WHERE c.feature IS NULL "
    "AND (CASE WHEN x(m, r.feature) <= r.split THEN r.lft ELSE r.rgt END) = p.node AND (CASE WHEN x(m, p.feature) <= p.split THEN p.lft ELSE p.rgt END) = c.node) w "
    "GROUP BY l_orderkey, l_linenumber, date, campaign_id".replace(
        "x(m, r.feature)", "CASE r.feature " + " ".join(f"WHEN '{c}' THEN {_clean('m.' + c)}" for c in _MODEL_FEATS) + " END").replace(
        "x(m, p.feature)", "CASE p.feature " + " ".join(f"WHEN '{c}' THEN {_clean('m.' + c)}" for c in _MODEL_FEATS) + " END"),
    ad_facts=S.AD_FACTS_SQL, m=S.METRICS_SQL, nd=_NODES_SQL, c="SELECT * FROM nd"))
def q_forest_scores(spark, d):
    """D4 with a saved model: the walk of every row through every tree, by the code that scores fitted forests."""
    import pandas as pd

    from adlens.operators.iforest import IsolationForestModel
    nodes = pd.DataFrame(saved_nodes(), columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])
    df = metric_facts(spark, d)
    score = IsolationForestModel(_MODEL_FEATS, nodes, 64, None, None).score_column(df)
    return df.select(*KEYS, roundn(score, 6).alias("iso_score"))


@register("forest_findings")
def q_forest_findings(spark, d):
    fl = detect(row_metrics(kept_facts(spark, d, TEXT_KEYS)), "iforest", FEATS, CONTAMINATION, n_trees=100)
    return X.finding_text(X.explain_findings(fl, FEATS)).select(
        "date", "campaign_name", "metric", "severity", "value", "description")


@register("context_json")
def q_context_json(spark, d):
    from adlens.plans.report_queries import _document
    return _document(spark, d)


@register("anomaly_json")
def q_anomaly_json(spark, d):
    f = findings(spark, d)
    return f.select(F.to_json(F.struct(
        F.col("date").cast("string").alias("date"), "campaign_id", "campaign_name", "metric", "value",
        F.array("expected_lo", "expected_hi").alias("expected_range"), "severity", "description",
    )).alias("record"))


# --------------------------------------------------------------------------- report tables

@register("kpi_cards", S.with_ctes(
    "SELECT * FROM (VALUES (0, 'IMPRESSIONS'), (1, 'CLICKS'), (2, 'CONVERSIONS'), (3, 'REVENUE'), (4, 'AD SPEND'), "
    "(5, 'ROI')) c(ordinal, label) CROSS JOIN LATERAL (SELECT CASE c.ordinal "
    f"WHEN 0 THEN {S.fmt_num('k.impressions', 0)} WHEN 1 THEN {S.fmt_num('k.clicks', 0)} "
    f"WHEN 2 THEN {S.fmt_num('k.conversions', 0)} WHEN 3 THEN concat('$', {S.fmt_num('k.revenue', 0)}) "
    f"WHEN 4 THEN concat('$', {S.fmt_num('k.spend', 0)}) ELSE concat({S.fmt_plain('k.roi', 1)}, '%') END AS value, "
    "CASE c.ordinal WHEN 0 THEN 'Total ad views' WHEN 1 THEN concat('CTR: ', "
    f"{S.fmt_plain('k.ctr', 2)}, '%') WHEN 2 THEN 'Completed actions' WHEN 3 THEN 'Total earnings' "
    "WHEN 4 THEN 'Investment' ELSE 'Return on investment' END AS subtitle, CASE WHEN c.ordinal = 5 THEN "
    "(CASE WHEN k.roi > 50 THEN 'good' WHEN k.roi > 0 THEN 'warn' ELSE 'bad' END) ELSE 'neutral' END AS band "
    "FROM kp k) v", ad_facts=S.AD_FACTS_SQL, kp=_KPI_SQL))
def q_kpi_cards(spark, d):
    return O.kpi_cards(kpi_totals(ad_facts(spark, d), money=money_sum), "lean")


@register("campaign_table", S.with_ctes(
    "SELECT campaign_name, substr(campaign_name, 1, 18) AS name, "
    f"{S.fmt_num('impressions', 0)} AS impressions, {S.fmt_num('clicks', 0)} AS clicks, "
    f"concat('$', {S.fmt_num('revenue', 0)}) AS revenue, concat('$', {S.fmt_num('spend', 0)}) AS spend, "
    f"concat({S.fmt_plain(S.safe_ratio('revenue - spend', 'spend', 100.0), 0)}, '%') AS roi "
    f"FROM (SELECT * FROM ({_ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 8) t",
    ad_facts=S.AD_FACTS_SQL))
def q_campaign_table(spark, d):
    return O.campaign_table(ad_facts(spark, d), "lean", money=money_sum)


@register("summary_text", findings_sql(
    "SELECT c.records, c.campaigns, fa.findings, concat('Data contains ', CAST(c.records AS VARCHAR), "
    "' records across ', CAST(c.campaigns AS VARCHAR), ' campaigns. Total revenue: $', "
    f"{S.fmt_num('k.revenue', 0)}, ', Total spend: $', {S.fmt_num('k.spend', 0)}, ', ROI: ', "
    f"{S.fmt_plain('k.roi', 1)}, '%.') AS summary, CASE WHEN fa.findings > 0 THEN "
    "'Attention needed - anomalies detected' ELSE 'All metrics within normal range' END AS status "
    "FROM (SELECT count(*) AS records, count(DISTINCT campaign_name) AS campaigns FROM ad_facts) c "
    "CROSS JOIN kp k CROSS JOIN (SELECT count(*) AS findings FROM f) fa", kp=_KPI_SQL))
def q_summary_text(spark, d):
    facts = kept_facts(spark, d, TEXT_KEYS)
    return R.summary_text(facts, findings(spark, d, facts), money=money_sum)


_DAILY = (f"SELECT date, {S.money_sum('revenue')} AS revenue, {S.money_sum('spend')} AS spend, "
          "sum(impressions) AS impressions, sum(clicks) AS clicks FROM ad_facts GROUP BY date")


@register("chart_series", S.with_ctes(
    "SELECT 'dashboard' AS chart, s.series, CAST(d.date AS VARCHAR) AS x, s.y, d.ord FROM "
    f"(SELECT *, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS ord, "
    f"{S.round2(S.safe_ratio('revenue - spend', 'spend', 100.0))} AS roi FROM dd) d "
    "CROSS JOIN LATERAL (VALUES ('impressions', CAST(d.impressions AS DOUBLE)), ('clicks', CAST(d.clicks AS DOUBLE)), "
    "('revenue', d.revenue), ('spend', d.spend), ('roi', d.roi)) s(series, y) "
    "UNION ALL SELECT 'campaign', 'revenue', campaign_name, revenue, "
    "CAST(row_number() OVER (ORDER BY revenue DESC, campaign_name) AS BIGINT) FROM "
    f"(SELECT * FROM ({_ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 10) t "
    "UNION ALL SELECT 'platform', 'revenue', platform, revenue, "
    "CAST(row_number() OVER (ORDER BY revenue DESC, platform) AS BIGINT) FROM "
    f"(SELECT platform, {S.money_sum('revenue')} AS revenue FROM ad_facts GROUP BY platform) p",
    ad_facts=S.AD_FACTS_SQL, dd=_DAILY))
def q_chart_series(spark, d):
    got = R.chart_series(ad_facts(spark, d), 10, money=money_sum)
    return got.withColumn("y", F.when(F.col("series") == "roi", round2("y")).otherwise(F.col("y")))


# --------------------------------------------------------------------------- model-response text

_WS = "[ \\t\\n\\r\\f\\x0B]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_ASSIST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"
_LINES = (
    "SELECT conv_id, turn, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS raw FROM "
    "(SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM a) s"
)
_KEPT = (
    f"SELECT conv_id, turn, line_no, regexp_replace({_strip_sql('raw')}, '^[0-9\\.\\-\\) \\*]+', '') AS rec "
    f"FROM ln WHERE length({_strip_sql('raw')}) >= 1 AND length(raw) >= 6"
)
_FIRST = (
    "SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CASE WHEN length(rec) > 80 THEN concat(CASE WHEN "
    "instr(substr(rec, 1, 77), ' ') > 0 THEN regexp_extract(substr(rec, 1, 77), '^(.*) ', 1) ELSE substr(rec, 1, 77) "
    "END, '...') ELSE rec END AS recommendation FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn "
    "ORDER BY line_no) AS pos FROM kept) r WHERE pos <= 4"
)


@register("recommendation_lines", S.with_ctes("SELECT * FROM fr", a=_ASSIST, ln=_LINES, kept=_KEPT, fr=_FIRST))
def q_recommendation_lines(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet").where(F.col("role") == "assistant")
    return R.recommendation_lines(conv, ["conv_id", "turn"], "text")


_WIDE_MARKS = "regexp_replace(" + _strip_sql("raw") + ", '^[0-9\\.\\-\u2022\\) ]+', '')"
_KEPT_WIDE = (
    "SELECT conv_id, turn, line_no, " + _strip_sql(_WIDE_MARKS) + " AS rec FROM ln "
    "WHERE regexp_matches(" + _strip_sql("raw") + ", '^[0-9\\-\u2022]')"
)


def _plain_kept(min_trim: int) -> str:
    return (f"SELECT conv_id, turn, line_no, regexp_replace({_strip_sql('raw')}, '^[0-9\\.\\-\\) ]+', '') AS rec "
            f"FROM ln WHERE length({_strip_sql('raw')}) >= {min_trim}")


def _first_k(k: int, extra: str = "") -> str:
    return ("SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, rec AS recommendation FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS pos FROM kept {extra}) r "
            f"WHERE pos <= {k}")


def _lines_query(mode: str):
    def q(spark, d):
        conv = spark.read.parquet(f"{d}/conversations.parquet").where(F.col("role") == "assistant")
        return R.recommendation_lines(conv, ["conv_id", "turn"], "text", mode=mode)
    return q


register("recommendation_lines_script", S.with_ctes(
    "SELECT * FROM fr", a=_ASSIST, ln=_LINES, kept=_plain_kept(11), fr=_first_k(4)))(_lines_query("script"))
register("recommendation_lines_quick", S.with_ctes(
    "SELECT * FROM fr", a=_ASSIST, ln=_LINES, kept=_plain_kept(1), fr=_first_k(3)))(_lines_query("quick"))


@register("recommendation_rows", S.with_ctes(
    "SELECT a.conv_id, a.turn, p.pos, coalesce(fr.recommendation, p.d) AS recommendation FROM a CROSS JOIN "
    "(VALUES (1, 'Optimize high-spend low-ROI campaigns'), (2, 'Scale top performers'), (3, 'Review anomalies'), "
    "(4, 'A/B test creatives')) p(pos, d) LEFT JOIN fr ON fr.conv_id = a.conv_id AND fr.turn = a.turn "
    "AND fr.pos = p.pos", a=_ASSIST, ln=_LINES, kept=_KEPT, fr=_FIRST))
def q_recommendation_rows(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet").where(F.col("role") == "assistant")
    return R.recommendation_rows(conv, ["conv_id", "turn"], "text")


@register("clean_paragraphs", S.with_ctes(
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN p LIKE '- %' OR p LIKE '* %' THEN "
    "concat('  - ', substr(p, 3)) ELSE p END AS paragraph FROM (SELECT doc_id, pos, "
    f"{_strip_sql('para')} AS p FROM sp) x WHERE length(p) > 0",
    sp="SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS para FROM (SELECT doc_id, "
       "string_split(replace(replace(replace(text, '**', ''), '##', ''), '# ', ''), chr(10) || chr(10)) AS parts "
       "FROM documents) s"))
def q_clean_paragraphs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return R.clean_paragraphs(docs, ["doc_id"], "text")
