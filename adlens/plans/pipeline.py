"""End to end: file -> normalized facts -> flag -> findings -> report tables (K1).

``analyze`` builds one lazy plan per report section. It persists exactly two
things: the normalized facts with row metrics (read by every section) and the
scored facts (read by the flag, the findings and the alerts). Sections are
written as one Parquet table each, partitioned by ``report_id`` (the file
stem) and ``run_ts``, so runs append side by side and a reader prunes to one
report by partition.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.text import LEAN_DEFAULT_RECOMMENDATIONS, WIDE_PAGE_RECOMMENDATIONS, report_title
from adlens.operators import explain as X
from adlens.operators import forms as O
from adlens.operators import report as R
from adlens.operators import rollups as A
from adlens.operators import series as T
from adlens.operators.detect import detect
from adlens.operators.features import feature_columns
from adlens.operators.metrics import row_metrics
from adlens.operators.normalize import normalize
from adlens.plans.publish import publish
from adlens.sources.readers import read_any

FORMAT_OF = {"csv": "csv", "json": "json", "ndjson": "ndjson", "parquet": "parquet",
             "sqlite": "sqlite", "db": "sqlite", "sqlite3": "sqlite"}


def report_id_of(path: str) -> str:
    """The file's stem and a hash of its whole path: files that differ in folder, ending or special characters differ."""
    stem = os.path.basename(path.rstrip("/")).rsplit(".", 1)[0]
    whole = path[len("file:"):] if path.startswith("file:") else path
    mark = hashlib.sha256(re.sub("^/+", "/", whole).encode()).hexdigest()[:10]
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', stem) or 'report'}-{mark}"


def stem_of(path: str) -> str:
    return os.path.basename(path.rstrip("/")).rsplit(".", 1)[0] or "report"


def load_and_normalize(spark: SparkSession, path: str, custom_mapping: dict | None = None, profile: str = "lean",
                       **kw):
    """Read any supported file and map it onto the canonical schema; returns (df, report)."""
    return normalize(read_any(spark, path, profile=profile), profile, custom_mapping=custom_mapping, **kw)


def analyze(df: DataFrame, profile: str = "lean", method: str = "iforest", contamination: float = 0.1,
            n_trees: int | None = None, feature_cols: list[str] | None = None, run_date=None,
            custom_mapping: dict | None = None, seed: int = 42, title_stem: str = "report") -> dict[str, DataFrame]:
    """All report sections of one input table as DataFrames (lazy, except the two persists and the fit)."""
    spark = df.sparkSession
    norm, rep = normalize(df, profile, custom_mapping=custom_mapping, run_date=run_date)
    # the lean form has the guarded CTR and ROI only, the wide form all metrics
    facts = row_metrics(norm, "guarded" if profile == "lean" else "ieee").persist(StorageLevel.MEMORY_AND_DISK)
    feats = feature_columns(facts, feature_cols) if profile == "wide" or feature_cols else \
        [c for c in ["impressions", "clicks", "spend", "revenue"] if c in facts.columns]
    trees = n_trees or (50 if profile == "lean" else 100)
    kept: list = []
    scored = detect(facts, method, feats, contamination, n_trees=trees, seed=seed, scale=(profile == "wide"),
                    guard=(profile == "lean"), keep=kept)
    if not kept:  # z-sum / guarded path: nothing cached yet
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(scored)
    findings = X.finding_text(X.explain_findings(scored, feats))
    kpis = A.kpi_totals(facts)
    mapping = spark.createDataFrame(rep.to_rows(), "source_column string, field string, how string")
    wide = profile == "wide"
    lines = WIDE_PAGE_RECOMMENDATIONS if wide else LEAN_DEFAULT_RECOMMENDATIONS
    recs = spark.createDataFrame(list(enumerate(lines, start=1)), "pos int, recommendation string")
    title = spark.range(1).select(report_title(F.lit(title_stem)).alias("title"))
    return {
        "mapping": mapping,
        "title": title,
        "kpis": kpis,
        "kpi_cards": O.kpi_cards(kpis, "wide" if wide else "lean"),
        "daily": T.daily_roi(facts, guarded=not wide),
        "campaigns": A.campaign_summary(facts),
        "campaign_table": O.campaign_table(facts, "wide" if wide else "lean"),
        "platforms": A.platform_share(facts) if "platform" in facts.columns else None,
        "alerts": X.row_alerts(scored.where("is_anomaly")),
        "findings": findings,
        "findings_summary": X.anomaly_summary(findings),
        "alert_lines": O.alert_lines(findings, "wide" if wide else "lean"),
        "findings_text": O.findings_short(findings, 5) if wide else X.findings_text(findings, 5),
        "summary": O.overview_text(kpis) if wide else R.summary_text(facts, findings),
        "status": O.status_text(facts, findings),
        "chart_series": R.chart_series(facts, 10),
        "recommendations": recs,
        "_facts": facts,
        "_cached": kept,
    }


def release(tables: dict) -> None:
    for df in tables.get("_cached", []):
        df.unpersist()
    if tables.get("_facts") is not None:
        tables["_facts"].unpersist()


def _drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_report(tables: dict[str, DataFrame], out_dir: str, report_id: str, run_ts: str | None = None) -> dict:
    """K1: one Parquet table per section under ``out_dir/<section>``, partitioned by report and run.

    Written with dynamic partition overwrite: writing the same (report_id, run_ts)
    again replaces that partition only, so a retried run (or a re-executed
    stream batch, which uses its batch id as ``run_ts``) leaves one copy.
    """
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    counts = {}
    for name, df in tables.items():
        if df is None or name.startswith("_"):
            continue
        # dynamic overwrite leaves a partition that gets no rows this time, so it goes first
        _drop_folder(df.sparkSession, f"{out_dir.rstrip('/')}/{name}/report_id={report_id}/run_ts={run_ts}")
        (df.withColumns({"report_id": F.lit(report_id), "run_ts": F.lit(run_ts)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("report_id", "run_ts").parquet(f"{out_dir.rstrip('/')}/{name}"))
        counts[name] = None
    return {"report_id": report_id, "run_ts": run_ts, "sections": sorted(counts)}


def process_file(spark: SparkSession, path: str, out_dir: str, profile: str = "lean", run_ts: str | None = None,
                 atomic: bool = False, **kw) -> dict:
    """3.1/3.2: read one file, build its report, write it; returns what was written.

    ``atomic``: all sections become visible by one commit (``plans.publish``) instead of one by one.
    """
    df = read_any(spark, path, profile=profile)
    rid = report_id_of(path)
    tables = analyze(df, profile=profile, title_stem=stem_of(path), **kw)
    try:
        return publish(tables, out_dir, rid) if atomic else write_report(tables, out_dir, rid, run_ts)
    finally:
        release(tables)
