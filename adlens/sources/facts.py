"""Canonical ad facts derived from the driver's star-schema tables.

``ad_facts`` is the scale input for every ad query: one row per line item,
with the canonical ad schema. The same view is written in DuckDB SQL in
``adlens.plans.sqltext`` so the oracle reads identical rows.

Plan shape (see ``explain``): lineitem and orders are the two large sides and
are joined on the order key with a shuffle (sort-merge, or none when both are
bucketed by the key); supplier/nation/region are the dimension side. Whether a
dimension is broadcast is left to the planner's size check
(``autoBroadcastJoinThreshold`` on file statistics, re-checked by AQE at run
time); supplier grows with the data, so it is never forced into a broadcast.
Only the columns below are read from the Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AD_SCHEMA_DDL = (
    "date DATE, campaign_id STRING, campaign_name STRING, impressions BIGINT, clicks BIGINT, "
    "conversions BIGINT, spend DOUBLE, revenue DOUBLE, region STRING, platform STRING"
)
AD_COLUMNS = [
    "date", "campaign_id", "campaign_name", "impressions", "clicks",
    "conversions", "spend", "revenue", "region", "platform",
]
METRICS = ["impressions", "clicks", "conversions", "spend", "revenue"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ad_facts(spark: SparkSession, sf_dir: str, keys: bool = True) -> DataFrame:
    """Line items as ad facts. ``keys`` keeps (l_orderkey, l_linenumber) for tie-breaks."""
    li = (table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    ))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    dims = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
              F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
              F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "r_name")
    )
    df = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(dims, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    cols = [
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("campaign_id"),
        F.col("s_name").alias("campaign_name"),
        F.floor("l_extendedprice").cast("bigint").alias("impressions"),
        (F.col("l_quantity").cast("bigint") * 10).alias("clicks"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("conversions"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("revenue"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("platform"),
    ]
    if keys:
        cols = [F.col("l_orderkey"), F.col("l_linenumber")] + cols
    return df.select(*cols)


def events_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily funnel per user bucket from ``events`` in the canonical ad schema.

    One pass with partial aggregation; the group key (day, bucket) is low
    cardinality, so the shuffle carries only partial sums.
    """
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    bucket = F.concat(F.lit("user_bucket_"), (F.col("user_id") % 10).cast("string"))
    return (
        ev.groupBy(F.col("ts").cast("date").alias("date"), bucket.alias("campaign_name"))
        .agg(
            F.count_if(F.col("event_type") == "view").alias("impressions"),
            F.count_if(F.col("event_type") == "click").alias("clicks"),
            F.count_if(F.col("event_type") == "purchase").alias("conversions"),
            F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)).alias("spend"),
            F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("revenue"),
        )
        .select(
            "date", F.col("campaign_name").alias("campaign_id"), "campaign_name",
            "impressions", "clicks", "conversions", "spend", "revenue",
            F.lit("Unknown").alias("region"), F.lit("Unknown").alias("platform"),
        )
    )
