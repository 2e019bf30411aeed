"""A folder of files to reports, all in one plan for each layout (S9, W5) instead of one run for each file.

The file's path is the report's key. It goes with every row through mapping, metrics, statistics, quantile, flag and
findings, so jobs and plans are as many as there are different layouts, whatever the number of files. Column names are
mapped once for each layout; types and dates are judged over all files of a layout.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.numeric import raw_sum
from adlens.operators import explain as X
from adlens.operators import grouped as G
from adlens.operators.features import feature_columns
from adlens.operators.metrics import row_metrics
from adlens.operators.normalize import normalize
from adlens.plans.pipeline import report_id_of
from adlens.sources import many as M
from adlens.sources.facts import AD_COLUMNS

KEY = M.PATH
FAILED = "path string, error string"


def numbered_by_report(df: DataFrame, start: int) -> DataFrame:
    """Row numbers that ran over all reports, begun anew in each (rows of a report follow each other)."""
    first = df.groupBy(KEY).agg(F.min(F.col("campaign_id").cast("long")).alias("__first"))
    return df.join(first, KEY).withColumn("campaign_id", (F.col("campaign_id").cast("long") - F.col("__first") + start).cast("string")).drop("__first")


def canonical_facts(df: DataFrame, profile: str = "lean", **kw) -> DataFrame:
    """The canonical columns and the report's key, with the row metrics of the profile."""
    norm, rep = normalize(df, profile, keep=[M.PATH, M.START, M.AT], order_by=[M.PATH, M.START, M.AT], **kw)
    if "campaign_id" in rep.synthetic and not (profile == "wide" and "campaign_name" not in rep.synthetic):
        norm = numbered_by_report(norm, 1 if profile == "lean" else 0)
    norm = norm.select(KEY, *AD_COLUMNS)
    if profile == "wide":
        return row_metrics(norm, "ieee")
    # the guard of the lean form looks at a report's totals
    some = norm.groupBy(KEY).agg((F.sum("impressions") > 0).alias("__i"), (F.sum("spend") > 0).alias("__s"))
    raw = row_metrics(norm, "ieee").select(*norm.columns, "ctr", "roi").join(some, KEY)
    fixed = lambda c, ok: F.when(F.col(ok), F.when(F.isnan(c), 0.0).otherwise(F.col(c))).otherwise(0.0)
    return raw.withColumns({"ctr": fixed("ctr", "__i"), "roi": fixed("roi", "__s")}).drop("__i", "__s")


def analyze_many(facts: DataFrame, profile: str = "lean", contamination: float = 0.1, feature_cols: list[str] | None = None, money=raw_sum) -> dict[str, DataFrame]:
    """The sections of all reports of one layout, each with the key column; the flag is the z-sum score's."""
    facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    feats = feature_columns(facts, feature_cols) if profile == "wide" or feature_cols else ["impressions", "clicks", "spend", "revenue"]
    stats = G.report_stats(facts, KEY, feats)
    flagged = G.flag_reports(facts, KEY, feats, stats, contamination, guard=profile == "lean").persist(StorageLevel.MEMORY_AND_DISK)
    findings = X.finding_text(X.explain_findings(flagged, feats, G.metric_stats(stats, KEY, feats), by=[KEY]))
    kpis = G.kpis_by_report(facts, KEY, money)
    return {
        "kpis": kpis, "daily": G.daily_by_report(facts, KEY, money), "campaigns": G.campaigns_by_report(facts, KEY, money),
        "platforms": G.platforms_by_report(facts, KEY, money), "alerts": _alerts(flagged), "findings": findings,
        "findings_text": G.texts_by_report(findings, kpis, KEY), "_cached": [facts, flagged],
    }


def _alerts(flagged: DataFrame) -> DataFrame:
    """D12 with the key: alerts of the flagged rows."""
    region = F.coalesce(F.col("region"), F.lit("Unknown"))
    return flagged.where("is_anomaly").select(
        KEY, "campaign_name", "date", region.alias("region"), "impressions", F.when(F.col("impressions") < 50000, "high").otherwise("medium").alias("severity"),
        X.alert_summary().alias("summary"))


def reports_of_folder(spark: SparkSession, folder: str, profile: str = "lean", strict: bool = True, **kw) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(sections of all files, malformed rows, failed files) of a folder.

    ``strict``: a file with a malformed row fails as a whole, as it does when read alone; otherwise its good rows are
    used. Either way the rows are in the second table. Database files are left to the reader of single files.
    """
    files = M.folder_files(spark, folder, {f for f in M.FORMATS if profile == "lean" or f != "ndjson"})
    found, blank = M.layouts(spark, [p for p, size in files if size])
    failed = spark.createDataFrame([(p, f"ValueError: {p} has no rows") for p in [*blank, *[p for p, size in files if not size]]], FAILED)
    sections: dict[str, DataFrame] = {}
    cached: list[DataFrame] = []
    rows = None
    for layout in found:
        good, bad = M.read_layout(spark, layout)
        if bad is not None:
            cached.append(good._checked_rows)  # noqa: SLF001
            rows = bad if rows is None else rows.unionByName(bad)
            if strict:
                worse = bad.groupBy("path").agg(F.concat(F.lit("RuntimeError: malformed rows: "), F.count(F.lit(1)).cast("string")).alias("error"))
                failed = failed.unionByName(worse)
                good = good.join(worse.select(F.col("path").alias(KEY)), KEY, "left_anti")
        tables = analyze_many(canonical_facts(good, profile, **kw), profile)
        cached += tables.pop("_cached")
        sections = {n: df if n not in sections else sections[n].unionByName(df) for n, df in tables.items()}
    sections["_cached"] = cached
    rows = rows if rows is not None else spark.createDataFrame([], "path string, row string, reason string")
    return sections, rows, failed


def write_folder_reports(spark: SparkSession, folder: str, out_dir: str, profile: str = "lean", run_ts: str = "run", **kw) -> list[str]:
    """Every section of all reports in one write, partitioned by run: ``out_dir/<section>/run_ts=...``; also the failed files
    and the malformed rows. Rows carry ``report_id``, as a single file's report does in its folder name."""
    sections, bad, failed = reports_of_folder(spark, folder, profile, **kw)
    cached = sections.pop("_cached")
    # paths are as many as the files; their ids are worked out here once, as they are for single files
    ids = spark.createDataFrame([(p, report_id_of(p)) for p, _ in M.folder_files(spark, folder, M.FORMATS)], f"{KEY} string, report_id string")
    try:
        for name, df in {**sections, "malformed_rows": bad.withColumnRenamed("path", KEY), "failed_files": failed.withColumnRenamed("path", KEY)}.items():
            out = df.join(ids, KEY, "left").withColumn("run_ts", F.lit(run_ts))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(f"{out_dir.rstrip('/')}/{name}")
    finally:
        for df in cached:
            df.unpersist()
    return sorted(sections)
