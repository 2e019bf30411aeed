"""Registered queries that go through files: tables are written in each format, read back by the readers and reported on.

The files are written by Spark below the shared scratch folder, so they grow with the tables; each query's SQL reads the
tables themselves, so a row or a type that is lost on the way shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from adlens.functions.numeric import money_sum, snap_round
from adlens.functions.text import report_title, title_from_metric
from adlens.operators import rollups as A
from adlens.operators.rows import stored
from adlens.plans import sqltext as S
from adlens.plans.catalog import ORACLE, facts_sql, register
from adlens.plans.many import FAILED, write_folder_reports
from adlens.plans.pipeline import load_and_normalize, write_report
from adlens.plans.publish import publish, published
from adlens.session import scratch_dir
from adlens.sources.facts import METRICS, ad_facts, table
from adlens.sources.readers import load_metadata, read_any
from adlens.streaming.folder import read_log, watch_folder

_ORDERS = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
ARRAY_KEYS = 20000


def _orders(df):
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus",
                     F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


# --------------------------------------------------------------------------- S1-S5, S7, S10

@register("read_csv", _ORDERS)
def q_read_csv(spark, d):
    # types are inferred from the text; the dates come back as dates
    path = f"{scratch_dir(spark, 'read-csv')}/orders.csv"
    _orders(table(spark, d, "orders")).write.option("header", True).csv(path)
    return _orders(read_any(spark, path))


@register("read_json_lines", _ORDERS)
def q_read_json_lines(spark, d):
    # the ending says array, the first character says lines
    path = f"{scratch_dir(spark, 'read-lines')}/orders.json"
    _orders(table(spark, d, "orders")).write.json(path)
    return _orders(read_any(spark, path))


@register("read_json_array", _ORDERS)
def q_read_json_array(spark, d):
    # one array a file, each of at most ARRAY_KEYS orders, as an order key occurs once
    path = f"{scratch_dir(spark, 'read-array')}/orders.json"
    rows = _orders(table(spark, d, "orders"))
    arrays = rows.groupBy(F.floor(F.col("o_orderkey") / ARRAY_KEYS).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return _orders(read_any(spark, f"{path}/part=*", fmt="json"))


@register("load_metadata", "SELECT 'orders.parquet' AS source, 'parquet' AS format, (SELECT count(*) FROM orders) AS row_count, "
          "count(*) AS column_count, string_agg(column_name, ',' ORDER BY column_index) AS column_names "
          "FROM duckdb_columns() WHERE table_name = 'orders'")
def q_load_metadata(spark, d):
    m = load_metadata(table(spark, d, "orders"), "orders.parquet", "parquet")
    return spark.createDataFrame([(m["source"], m["format"], m["rows"], m["columns"], ",".join(m["column_names"]))],
                                 "source string, format string, row_count bigint, column_count bigint, column_names string")


# --------------------------------------------------------------------------- N2, N5, N12, N13

_EXPORT = {"date": "Report Day", "campaign_name": "Ad Name", "impressions": "Impr.", "clicks": "Taps", "conversions": "Sign-ups", "spend": "Media Cost",
           "revenue": "Gross", "region": "Market", "platform": "Channel"}


def _export(spark, d, name):
    """The facts as an ad platform might export them: a CSV with columns of its own names."""
    path = f"{scratch_dir(spark, name)}/export.csv"
    ad_facts(spark, d, keys=False).select(*[F.col(c).alias(n) for c, n in _EXPORT.items()]).write.option("header", True).csv(path)
    return path


_FACT_SUMS = ("count(*) AS row_count, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, "
              f"CAST(sum(conversions) AS BIGINT) AS conversions, {S.snap_round('sum(spend)', 2)} AS spend, {S.snap_round('sum(revenue)', 2)} AS revenue")


def _fact_sums():
    return [F.count(F.lit(1)).alias("row_count"), *[F.sum(c).cast("bigint").alias(c) for c in ("impressions", "clicks", "conversions")],
            *[snap_round(F.sum(c), 2).alias(c) for c in ("spend", "revenue")]]


@register("load_and_normalize", facts_sql(f"SELECT date, campaign_name, region, platform, {_FACT_SUMS} FROM ad_facts GROUP BY ALL"))
def q_load_and_normalize(spark, d):
    # "Gross" has no pattern; the custom mapping gives it its field
    out, _ = load_and_normalize(spark, _export(spark, d, "normalize"), custom_mapping={"Gross": "revenue"})
    return out.groupBy("date", "campaign_name", "region", "platform").agg(*_fact_sums())


@register("mapping_report", "SELECT * FROM (VALUES ('Report Day', 'date', 'pattern'), ('Ad Name', 'campaign_name', 'pattern'), ('Impr.', 'impressions', 'pattern'), "
          "('Taps', 'clicks', 'pattern'), ('Sign-ups', 'conversions', 'custom'), ('Media Cost', 'spend', 'pattern'), ('Gross', 'revenue', 'custom'), "
          "('Market', 'region', 'pattern'), ('Channel', 'platform', 'pattern'), (NULL, 'campaign_id', 'synthetic')) t(source_column, field, how)")
def q_mapping_report(spark, d):
    _, rep = load_and_normalize(spark, _export(spark, d, "mapping"), custom_mapping={"Gross": "revenue", "Sign-ups": "conversions"})
    return spark.createDataFrame(rep.to_rows(), "source_column string, field string, how string")


# --------------------------------------------------------------------------- K1

@register("report_bundle", ORACLE["campaign_summary"])
def q_report_bundle(spark, d):
    # written twice under one run: the second write replaces the first
    out = scratch_dir(spark, "bundle")
    facts = stored(ad_facts(spark, d).select("campaign_name", *METRICS), "bundle-facts")  # read by each section and write
    sections = {"kpis": A.kpi_totals(facts), "campaigns": A.campaign_summary(facts, money=money_sum)}
    for _ in range(2):
        write_report(sections, out, "ads", "r1")
    return spark.read.parquet(f"{out}/campaigns").where("report_id = 'ads' AND run_ts = 'r1'").drop("report_id", "run_ts")


@register("report_published", ORACLE["daily_metrics"])
def q_report_published(spark, d):
    out = scratch_dir(spark, "published")
    publish({"kpis": A.kpi_totals(ad_facts(spark, d)), "daily": _QUERY("daily_metrics")(spark, d)}, out, "ads")
    return published(spark, out, "ads")["daily"]


def _QUERY(name):
    from adlens.plans.catalog import QUERIES
    return QUERIES[name]


# --------------------------------------------------------------------------- S9, W1, W2, W5, W6

_REPORT_SUMS = facts_sql(f"SELECT {_FACT_SUMS.split(', ', 1)[1]}, true AS all_files_ok FROM ad_facts")


def _inbox(spark, d, name):
    """The facts as many files of two formats in one folder."""
    inbox = scratch_dir(spark, name)
    facts = stored(ad_facts(spark, d, keys=False), f"{name}-facts")  # read by both writes
    early = F.coalesce(F.year("date") % 2 == 0, F.lit(False))
    facts.where(early).write.mode("append").parquet(inbox)
    facts.where(~early).write.mode("append").option("header", True).csv(inbox)
    return inbox


def _sum_of_reports(kpis, ok):
    """Totals over all reports; ``ok`` is a one-row table."""
    both = kpis.agg(*_fact_sums()[1:]).withColumn("all_files_ok", F.lit(None).cast("boolean")).unionByName(ok, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@register("folder_reports", _REPORT_SUMS)
def q_folder_reports(spark, d):
    out = scratch_dir(spark, "folder-reports")
    write_folder_reports(spark, _inbox(spark, d, "folder-inbox"), out, run_ts="r1")
    failed = spark.read.schema(FAILED).parquet(f"{out}/failed_files").agg((F.count(F.lit(1)) == 0).alias("all_files_ok"))
    return _sum_of_reports(spark.read.parquet(f"{out}/kpis"), failed)


@register("watched_reports", _REPORT_SUMS)
def q_watched_reports(spark, d):
    out = scratch_dir(spark, "watched-reports")
    watch_folder(spark, _inbox(spark, d, "watched-inbox"), out, method="zsum").awaitTermination()
    ok = read_log(spark, out).agg(F.bool_and(F.col("status") == "ok").alias("all_files_ok"))
    return _sum_of_reports(spark.read.parquet(f"{out}/kpis"), ok)


# --------------------------------------------------------------------------- R3, R13

def _title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


@register("display_titles", "SELECT o_orderpriority AS stem, count(*) AS row_count, " + _title_sql("translate(o_orderpriority, '_-', '  ')") + " AS title, "
          + _title_sql("replace(concat(lower(o_orderpriority), '_rate'), '_', ' ')") + " AS name FROM orders GROUP BY o_orderpriority")
def q_display_titles(spark, d):
    stems = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stem")).agg(F.count(F.lit(1)).alias("row_count"))
    return stems.select("stem", "row_count", report_title(F.col("stem")).alias("title"), title_from_metric(F.concat(F.lower("stem"), F.lit("_rate"))).alias("name"))
