"""Registered queries for the column normalizer, run on the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.operators.normalize import DATE_FORMATS, discover_catalog, infer_column_types, map_columns_catalog, normalize, parse_dates
from adlens.operators.rollups import campaign_summary
from adlens.operators.rows import stored
from adlens.plans import sqltext as S
from adlens.plans.catalog import register
from adlens.functions.numeric import money_sum
from adlens.sources.facts import ad_facts, events_funnel, table
from adlens.sources.footers import footer_profile

_TAIL = "'Unknown' AS region, 'Unknown' AS platform, event_type, props FROM events"


@register("normalize_events", (
    "SELECT CAST(ts AS DATE) AS date, CAST(row_number() OVER (ORDER BY event_id) AS VARCHAR) AS campaign_id, "
    "'Campaign_1' AS campaign_name, CAST(event_id AS BIGINT) AS impressions, CAST(user_id AS BIGINT) AS clicks, "
    "CAST(0 AS BIGINT) AS conversions, CAST(0.0 AS DOUBLE) AS spend, CAST(value AS DOUBLE) AS revenue, " + _TAIL))
def q_normalize_events(spark, d):
    # lean: value -> revenue (name), ts -> date and event_id -> impressions (type),
    # user_id -> clicks (adopted); the 1..n ids follow event_id
    out, _ = normalize(table(spark, d, "events"), "lean", order_by=["event_id"])
    return out


@register("normalize_events_wide", (
    "SELECT CAST(ts AS DATE) AS date, CAST(event_id AS VARCHAR) AS campaign_id, "
    "CAST(event_id AS VARCHAR) AS campaign_name, CAST(user_id AS BIGINT) AS impressions, "
    "CAST(0 AS BIGINT) AS clicks, CAST(0 AS BIGINT) AS conversions, CAST(0.0 AS DOUBLE) AS spend, "
    "CAST(value AS DOUBLE) AS revenue, " + _TAIL))
def q_normalize_events_wide(spark, d):
    # wide: event_id -> campaign_id ('id'), value -> revenue, ts -> date (type), user_id -> impressions (adopted)
    out, _ = normalize(table(spark, d, "events"), "wide")
    return out


def _num_kind(c: str, large: float, decimal: bool) -> str:
    dec = "WHEN TRUE THEN 'metric_decimal' " if decimal else ""
    return f"CASE WHEN avg({c}) > {large} THEN 'metric_large' {dec}ELSE 'metric_small' END"


def _text_kind(c: str, wide: bool) -> str:
    pats = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}" + (r"|\d{2}-\d{2}-\d{4}" if wide else "")
    other = (f"CASE WHEN count(DISTINCT {c}) / count({c}) > 0.5 THEN 'categorical_high_cardinality' "
             "ELSE 'categorical' END") if wide else "'text'"
    return (f"CASE WHEN count({c}) > 0 AND count_if(regexp_matches({c}, '^({pats})')) * 2 >= count({c}) "
            f"THEN 'date' ELSE {other} END")


_INFER = [
    ("event_id", "bigint", _num_kind("event_id", 100, False), _num_kind("event_id", 1000, False)),
    ("ts", "timestamp_ntz", "'date'", "'date'"),
    ("user_id", "bigint", _num_kind("user_id", 100, False), _num_kind("user_id", 1000, False)),
    ("event_type", "string", _text_kind("event_type", False), _text_kind("event_type", True)),
    ("value", "double", _num_kind("value", 100, False), _num_kind("value", 1000, True)),
    ("props", "string", _text_kind("props", False), _text_kind("props", True)),
]


@register("infer_column_types", "\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, {lean} AS lean_type, "
    f"{wide} AS wide_type FROM events" for i, (c, t, lean, wide) in enumerate(_INFER)))
def q_infer_column_types(spark, d):
    return infer_column_types(table(spark, d, "events"))


@register("parse_dates", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS day FROM events")
def q_parse_dates(spark, d):
    ev = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return parse_dates(ev, ["day"])


_FUNNEL_SQL = (
    "SELECT CAST(ts AS DATE) AS date, concat('user_bucket_', CAST(user_id % 10 AS VARCHAR)) AS campaign_name, "
    "count_if(event_type = 'view') AS impressions, count_if(event_type = 'click') AS clicks, "
    "count_if(event_type = 'purchase') AS conversions, "
    "coalesce(sum(CASE WHEN event_type = 'click' THEN value END), 0.0) AS spend, "
    "coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0.0) AS revenue "
    "FROM events GROUP BY 1, 2"
)


@register("funnel_summary", S.with_ctes(
    "SELECT campaign_name, impressions, clicks, conversions, spend, revenue, "
    f"{S.round2(S.safe_ratio('clicks', 'impressions', 100.0))} AS ctr, "
    f"{S.roundn(S.safe_ratio('revenue - spend', 'spend', 100.0), 1)} AS roi "
    f"FROM (SELECT campaign_name, coalesce({S.isum('impressions')}, 0) AS impressions, "
    f"coalesce({S.isum('clicks')}, 0) AS clicks, coalesce({S.isum('conversions')}, 0) AS conversions, "
    f"coalesce({S.money_sum('spend')}, 0.0) AS spend, coalesce({S.money_sum('revenue')}, 0.0) AS revenue "
    "FROM fn GROUP BY campaign_name) g", fn=_FUNNEL_SQL))
def q_funnel_summary(spark, d):
    # the ad rollup over a second derived fact source: daily funnel per user bucket from events
    return campaign_summary(events_funnel(spark, d), money=money_sum)


# --------------------------------------------------------------------------- catalog discovered from data

_OBJECT = ("concat('{\"day\": \"', strftime(ts, '%Y-%m-%d'), '\", \"day_part\": ', CAST(hour(ts) AS VARCHAR), ', \"', event_type, '_value\": ', "
           "coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 'null'), '.5, ', substr(props, 2))")


def _objects(spark, d):
    """Events as JSON objects whose keys depend on the type of event, with the keys of their props."""
    cents = F.coalesce(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("null"))
    text = F.concat(F.lit('{"day": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('", "day_part": '), F.hour("ts").cast("string"), F.lit(', "'), F.col("event_type"),
                    F.lit('_value": '), cents, F.lit(".5, "), F.substr("props", F.lit(2)))
    return table(spark, d, "events").select("event_type", text.alias("object"))


# ---- expected fields, by the names that occur (the second of two dates of a feed gets none) ----
_FIELD = "CASE column_name WHEN 'day' THEN 'date' WHEN 'click_value' THEN 'clicks' WHEN 'purchase_value' THEN 'conversions' WHEN 'signup_value' THEN 'conversions' " \
         "WHEN 'view_value' THEN 'revenue' WHEN 'error_value' THEN 'revenue' END"


@register("catalog_fields", S.with_ctes(
    f"SELECT feed, CAST(row_number() OVER (PARTITION BY feed ORDER BY column_name) - 1 AS INTEGER) AS ordinal, column_name, dtype, rows, {_FIELD} AS field FROM "
    "(SELECT feed, column_name, CASE WHEN bool_or(t = 'VARCHAR') THEN 'STRING' WHEN bool_or(t = 'DOUBLE') THEN 'DOUBLE' ELSE 'BIGINT' END AS dtype, count(*) AS rows "
    "FROM (SELECT feed, k AS column_name, json_type(o, '$.' || k) AS t FROM ks) x GROUP BY feed, column_name) g",
    ob=f"SELECT event_type AS feed, {_OBJECT} AS o FROM events", ks="SELECT feed, o, unnest(json_keys(o)) AS k FROM ob WHERE json_valid(o)"))
def q_catalog_fields(spark, d):
    catalog = discover_catalog(_objects(spark, d), "event_type", "object")
    fields = map_columns_catalog(catalog, "lean")
    return catalog.join(fields.select("feed", "column_name", "field"), ["feed", "column_name"]).select("feed", "ordinal", "column_name", "dtype", "rows", "field")


# --------------------------------------------------------------------------- dates as text, in every format

_STRFTIME = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "dd-MM-yyyy": "%d-%m-%Y", "dd/MM/yyyy": "%d/%m/%Y", "yyyy.MM.dd": "%Y.%m.%d", "dd.MM.yyyy": "%d.%m.%Y"}
_MIXED = "CASE WHEN l_orderkey % 2 = 0 THEN strftime(date, '%Y-%m-%d') ELSE strftime(date, '%d/%m/%Y') END"


@register("normalize_date_formats", S.with_ctes(
    " UNION ALL ".join(f"SELECT '{f}' AS format, CAST(date AS VARCHAR) AS day, count(*) AS n FROM ad_facts GROUP BY date" for f in _STRFTIME)
    + f" UNION ALL SELECT 'mixed' AS format, {_MIXED} AS day, count(*) AS n FROM ad_facts GROUP BY 2", ad_facts=S.AD_FACTS_SQL))
def q_normalize_date_formats(spark, d):
    """The same days as text in each format become dates; a column in two formats stays text."""
    mixed = F.when(F.col("l_orderkey") % 2 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    texts = [(f, F.date_format("date", f)) for f in DATE_FORMATS] + [("mixed", mixed)]
    feeds, out = stored(ad_facts(spark, d).select("impressions", *[text.alias(f"day{i}") for i, (_, text) in enumerate(texts)]), "dates"), None  # two passes for each text
    for i, (name, _) in enumerate(texts):
        feed = feeds.select(F.col(f"day{i}").alias("day"), F.lit("1").alias("campaign_id"), "impressions")
        got, rep = normalize(feed, "lean")
        part = got.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("format"), F.col("date").cast("string").alias("day"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------- a table's profile from its footers

_ORDERS = [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_orderdate", False)]


def _footer_sql() -> str:
    ends = lambda c, yes: f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max" if yes else "CAST(NULL AS VARCHAR) AS min, CAST(NULL AS VARCHAR) AS max"
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, {ends(c, yes)} FROM orders" for c, yes in _ORDERS)


@register("footer_profile", _footer_sql())
def q_footer_profile(spark, d):
    return footer_profile(spark, f"{d}/orders.parquet").where(F.col("column_name").isin([c for c, _ in _ORDERS])).select("column_name", "row_count", "null_count", "min", "max")
