"""Registered queries of the report variants (see ``operators.forms``) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions import text as T
from adlens.functions.numeric import money_sum, round2
from adlens.operators import forms as O
from adlens.operators import report as R
from adlens.operators.rollups import kpi_totals
from adlens.plans import findings_queries as Q
from adlens.plans import sqltext as S
from adlens.plans.catalog import register
from adlens.sources.facts import ad_facts


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template(template: str, values: dict[str, str]) -> str:
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [_text(before), values[name]]
    return "concat(" + ", ".join([*out, _text(rest)]) + ")"


# ---- fixed values: what each form of cards, tables and alert lines must show, as SQL text ----
_CARDS = {
    "wide": ("CASE WHEN roi > 100 THEN 'good' ELSE 'warn' END", "'neutral'",
             [("Total Impressions", "NULL"), ("Total Clicks", "NULL"), ("Total Conversions", "NULL"), ("Total Revenue", "NULL"),
              ("Total Spend", "NULL"), ("Overall ROI", "NULL")]),
    "slides": ("CASE WHEN roi > 50 THEN 'good' ELSE 'bad' END", "'neutral'",
               [("IMPRESSIONS", "'Total ad views delivered'"), ("CLICKS", f"concat('Click-through rate: ', {S.fmt_plain('ctr', 2)}, '%')"),
                ("CONVERSIONS", "'Completed actions'"), ("REVENUE", "'Total earnings generated'"), ("AD SPEND", "'Marketing investment'"),
                ("ROI", "'Return on investment'")]),
    "script": ("NULL", "NULL", [("Impressions", "NULL"), ("Clicks", "NULL"), ("Conversions", "NULL"), ("Revenue", "NULL"), ("Spend", "NULL"), ("ROI", "NULL")]),
}
_CTR_TEXT = f"concat({S.fmt_plain(S.safe_ratio('clicks', 'impressions', 100.0), 2)}, '%') AS ctr, "
_SPEND_TEXT = f"concat('$', {S.fmt_num('spend', 0)}) AS spend, "
_TABLES = {  # name, column before the ROI, digits of the ROI, rows
    "wide": ("substr(campaign_name, 1, 18)", _CTR_TEXT, 1, "LIMIT 10"),
    "script": ("substr(campaign_name, 1, 15)", _SPEND_TEXT, 1, ""),
    "quick": ("campaign_name", "", 0, ""),
}
_ALERTS = {  # header, text of a finding, findings shown
    "lean": ("concat('ANOMALIES DETECTED (', n, ')')", "concat('* ', substr(description, 1, 70))", 4),
    "slides": ("concat('ANOMALIES DETECTED: ', n, ' unusual patterns identified')", "concat('  -  ', substr(description, 1, 75))", 3),
    "script": ("concat('Anomaly Alerts (', n, ' detected)')", "substr(description, 1, 70)", 3),
    "wide": ("concat(n, ' anomalies detected during the reporting period:')", "substr(description, 1, 80)", 5),
    "quick": ("concat('ANOMALIES DETECTED (', n, ')')", "substr(description, 1, 75)", 4),
}
_METRIC_TITLES = ("CASE metric WHEN 'impressions' THEN 'Impressions' WHEN 'clicks' THEN 'Clicks' WHEN 'conversions' THEN 'Conversions' WHEN 'spend' THEN 'Spend' "
                  "WHEN 'revenue' THEN 'Revenue' WHEN 'ctr' THEN 'Ctr' WHEN 'conversion_rate' THEN 'Conversion Rate' WHEN 'cpa' THEN 'Cpa' WHEN 'roi' THEN 'Roi' "
                  "WHEN 'roas' THEN 'Roas' END")


def _cards_sql(form: str) -> str:
    band, other, cards = _CARDS[form]
    values = [S.fmt_num("impressions", 0), S.fmt_num("clicks", 0), S.fmt_num("conversions", 0), f"concat('$', {S.fmt_num('revenue', 0)})",
              f"concat('$', {S.fmt_num('spend', 0)})", f"concat({S.fmt_plain('roi', 1)}, '%')"]
    rows = [f"SELECT {i} AS ordinal, '{label}' AS label, {v} AS value, CAST({sub} AS VARCHAR) AS subtitle, CAST({band if i == 5 else other} AS VARCHAR) AS band FROM kp"
            for i, ((label, sub), v) in enumerate(zip(cards, values, strict=True))]
    return S.with_ctes(" UNION ALL ".join(rows), ad_facts=S.AD_FACTS_SQL, kp=Q._KPI_SQL)


def _table_sql(form: str) -> str:
    name, before, digits, rows = _TABLES[form]
    return S.with_ctes(
        f"SELECT campaign_name, {name} AS name, {S.fmt_num('impressions', 0)} AS impressions, {S.fmt_num('clicks', 0)} AS clicks, "
        f"concat('$', {S.fmt_num('revenue', 0)}) AS revenue, {before}concat({S.fmt_plain(S.safe_ratio('revenue - spend', 'spend', 100.0), digits)}, '%') AS roi "
        f"FROM (SELECT * FROM ({Q._ROLLUP}) g ORDER BY revenue DESC, campaign_name {rows}) t", ad_facts=S.AD_FACTS_SQL)


def _alerts_sql(form: str) -> str:
    header, text, k = _ALERTS[form]
    none, more = (", NULL AS title, NULL AS badge", f", concat(coalesce(campaign_name, 'Unknown'), ' - ', {_METRIC_TITLES}), upper(severity)") if form == "wide" else ("", "")
    return Q.findings_sql(
        f"SELECT 0 AS pos, {header} AS line{none} FROM (SELECT CAST(count(*) AS VARCHAR) AS n FROM f) h UNION ALL "
        f"SELECT CAST(row_number() OVER ({Q._TOP_ORDER}) AS INTEGER), {text}{more} FROM (SELECT * FROM f {Q._TOP_ORDER} LIMIT {k}) t")


def _register_forms() -> None:
    for form in _CARDS:
        register(f"kpi_cards_{form}", _cards_sql(form))(
            lambda spark, d, form=form: O.kpi_cards(kpi_totals(ad_facts(spark, d), money=money_sum), form))
    for form in _TABLES:
        register(f"campaign_table_{form}", _table_sql(form))(
            lambda spark, d, form=form: O.campaign_table(ad_facts(spark, d), form, money=money_sum))
    for form in _ALERTS:
        register(f"alert_lines_{form}", _alerts_sql(form))(lambda spark, d, form=form: O.alert_lines(Q.findings(spark, d), form))


_register_forms()


@register("row_alerts_quick", Q.flag_sql(
    "SELECT campaign_name, date, coalesce(region, 'Unknown') AS region, concat(coalesce(campaign_name, 'Unknown Campaign'), ' - unusual metrics on ', coalesce(CAST(date AS VARCHAR), 'Unknown Date'), "
    "' (', coalesce(region, 'Unknown'), ')') AS description FROM fl WHERE is_anomaly"))
def q_row_alerts_quick(spark, d):
    return O.quick_alerts(Q.flagged_facts(spark, d, Q.TEXT_KEYS))


_MONEY = {c: f"concat('$', {S.fmt_num(c, 2)})" for c in ("revenue", "spend")}


@register("overview_text", S.with_ctes(
    "SELECT " + _template(T.SUMMARY_OVERVIEW, {**{c: S.fmt_num(c, 0) for c in ("impressions", "clicks", "conversions")}, **_MONEY,
                                               "roi": f"concat({S.fmt_plain('roi', 1)}, '%')"}) + " AS summary FROM kp",
    ad_facts=S.AD_FACTS_SQL, kp=Q._KPI_SQL))
def q_overview_text(spark, d):
    return O.overview_text(kpi_totals(ad_facts(spark, d), money=money_sum))


@register("status_text", Q.findings_sql(
    "SELECT records, findings, " + _template(T.SUMMARY_STATUS, {
        "records": S.fmt_num("records", 0), "findings": "CAST(findings AS VARCHAR)",
        "status": f"CASE WHEN findings > 0 THEN {_text(T.STATUS_ATTENTION)} ELSE {_text(T.STATUS_NORMAL)} END"}) + " AS summary "
    "FROM (SELECT count(*) AS records FROM ad_facts) a CROSS JOIN (SELECT count(*) AS findings FROM f) b"))
def q_status_text(spark, d):
    facts = Q.kept_facts(spark, d, Q.TEXT_KEYS)
    return O.status_text(facts, Q.findings(spark, d, facts))


# --------------------------------------------------------------------------- recommendations from list-like texts

def _list_texts(spark, d):
    """Assistant turns as lists: each sentence a line, marked by its conversation's number."""
    conv = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'")
    mark = F.expr("CASE conv_id % 4 WHEN 0 THEN '1. ' WHEN 1 THEN '- ' WHEN 2 THEN '• ' ELSE '' END")
    return conv.select("conv_id", "turn", F.concat(mark, F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("\n"), mark))).alias("text"))


_LISTED = ("SELECT conv_id, turn, concat(mk, replace(text, '. ', concat(chr(10), mk))) AS text FROM (SELECT *, CASE conv_id % 4 WHEN 0 THEN '1. ' "
           "WHEN 1 THEN '- ' WHEN 2 THEN '• ' ELSE '' END AS mk FROM conversations WHERE role = 'assistant') q")


def _fixed(lines: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(lines, 1)) + ") v(pos, recommendation)"


_WIDE_BODY = ("SELECT * FROM fr UNION ALL SELECT a.conv_id, a.turn, CAST(v.pos AS INTEGER), v.recommendation FROM a CROSS JOIN {fixed} "
              "WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.conv_id = a.conv_id AND fr.turn = a.turn)")
_WIDE_CTES = {"a": _LISTED, "ln": Q._LINES, "kept": Q._KEPT_WIDE, "fr": Q._first_k(5, "WHERE length(rec) > 0")}

register("recommendation_lines_wide", S.with_ctes("SELECT * FROM fr", **_WIDE_CTES))(
    lambda spark, d: R.recommendation_lines(_list_texts(spark, d), ["conv_id", "turn"], "text", mode="wide"))
register("wide_recommendations", S.with_ctes(_WIDE_BODY.format(fixed=_fixed(T.WIDE_DEFAULT_RECOMMENDATIONS)), **_WIDE_CTES))(
    lambda spark, d: O.wide_recommendations(_list_texts(spark, d), ["conv_id", "turn"]))
register("wide_page_recommendations", S.with_ctes(_WIDE_BODY.format(fixed=_fixed(T.WIDE_PAGE_RECOMMENDATIONS)), **_WIDE_CTES))(
    lambda spark, d: O.wide_recommendations(_list_texts(spark, d), ["conv_id", "turn"], page=True))


@register("valid_recommendations", S.with_ctes(
    "SELECT conv_id, turn, pos, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM fr "
    f"WHERE length({Q._strip_sql('recommendation')}) >= 4) q WHERE n <= 4",
    a=_LISTED, ln=Q._LINES, kept=Q._plain_kept(1), fr=Q._first_k(3)))
def q_valid_recommendations(spark, d):
    keys = ["conv_id", "turn"]
    return O.valid_recommendations(R.recommendation_lines(_list_texts(spark, d), keys, mode="quick"), keys)


# several turns joined by blank lines, every third one a bullet: all branches of the paragraph rule
@register("paragraphs_of_conversations", S.with_ctes(
    "SELECT conv_id, CAST(pos AS INTEGER) AS pos, CASE WHEN p LIKE '- %' OR p LIKE '* %' THEN concat('  - ', substr(p, 3)) ELSE p END AS paragraph "
    f"FROM (SELECT conv_id, pos, {Q._strip_sql('para')} AS p FROM sp) x WHERE length(p) > 0",
    sp="SELECT conv_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS para FROM (SELECT conv_id, string_split(replace(replace(replace("
       "string_agg(concat(CASE turn % 3 WHEN 0 THEN '## ' WHEN 1 THEN '- ' ELSE '**' END, text), chr(10) || chr(10) ORDER BY turn, role, text), '**', ''), '##', ''), '# ', ''), "
       "chr(10) || chr(10)) AS parts FROM conversations GROUP BY conv_id) s"))
def q_paragraphs_of_conversations(spark, d):
    mark = F.expr("CASE turn % 3 WHEN 0 THEN '## ' WHEN 1 THEN '- ' ELSE '**' END")
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text", F.concat(mark, "text").alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "t"))).alias("l")).select(
        "conv_id", F.array_join(F.transform("l", lambda s: s["t"]), "\n\n").alias("text"))
    return R.clean_paragraphs(whole, ["conv_id"])


# --------------------------------------------------------------------------- the context document, read back

def _document(spark, d):
    facts = Q.kept_facts(spark, d, Q.TEXT_KEYS)
    return O.context_document(facts, Q.findings(spark, d, facts), Q.facts_totals(facts), money=money_sum)


_SHAPE = ("struct<reporting_period:string,total_records:bigint,metrics:struct<total_impressions:bigint,total_revenue:double,average_roi:double>,"
          "campaign_count:bigint,top_campaigns:array<struct<name:string,revenue:double,roi:double>>,"
          "anomaly_summary:struct<total_anomalies:bigint,high_severity:bigint,affected_campaigns:array<string>>,"
          "anomaly_details:array<struct<date:string,campaign_name:string,metric:string,value:double,severity:string,description:string>>>")


@register("context_document_fields", Q.findings_sql(
    "SELECT concat_ws(' to ', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)) AS reporting_period, count(*) AS total_records, "
    "any_value(kp.impressions) AS total_impressions, any_value(kp.revenue) AS total_revenue, " + S.round2("any_value(kp.roi)") + " AS average_roi, "
    "count(DISTINCT campaign_name) AS campaign_count, "
    f"(SELECT string_agg(campaign_name, '|' ORDER BY revenue DESC, campaign_name) FROM (SELECT * FROM ({Q._ROLLUP}) g ORDER BY revenue DESC, campaign_name LIMIT 10) t) AS top_campaigns, "
    "(SELECT count(*) FROM f) AS total_anomalies, (SELECT count(*) FROM f WHERE severity = 'high') AS high_severity, "
    "(SELECT string_agg(campaign_name, '|' ORDER BY campaign_name) FROM (SELECT DISTINCT campaign_name FROM f) q) AS affected_campaigns, "
    f"(SELECT string_agg(description, '|' {Q._TOP_ORDER}) FROM (SELECT * FROM f {Q._TOP_ORDER} LIMIT 10) t) AS anomaly_details FROM ad_facts, kp", kp=Q._KPI_SQL))
def q_context_document_fields(spark, d):
    c = _document(spark, d).select(F.from_json("context", _SHAPE).alias("c"))
    names = lambda a, f: F.array_join(F.transform(a, lambda s: s[f]), "|")
    return c.select(
        "c.reporting_period", "c.total_records", "c.metrics.total_impressions", "c.metrics.total_revenue", round2(F.col("c.metrics.average_roi")).alias("average_roi"),
        "c.campaign_count", names("c.top_campaigns", "name").alias("top_campaigns"), "c.anomaly_summary.total_anomalies", "c.anomaly_summary.high_severity",
        F.array_join("c.anomaly_summary.affected_campaigns", "|").alias("affected_campaigns"), names("c.anomaly_details", "description").alias("anomaly_details"))


@register("anomaly_json_fields", Q.findings_sql(
    "SELECT CAST(date AS VARCHAR) AS date, campaign_id, campaign_name, metric, value, expected_lo, expected_hi, severity, description FROM f"))
def q_anomaly_json_fields(spark, d):
    shape = "date string, campaign_id string, campaign_name string, metric string, value double, expected_range array<double>, severity string, description string"
    r = Q.q_anomaly_json(spark, d).select(F.from_json("record", shape).alias("r"))
    return r.select("r.date", "r.campaign_id", "r.campaign_name", "r.metric", "r.value", F.col("r.expected_range")[0].alias("expected_lo"),
                    F.col("r.expected_range")[1].alias("expected_hi"), "r.severity", "r.description")
