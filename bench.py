"""Benchmark of the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3; the median is reported, after one warm-up run).

Every query runs to completion through the ``noop`` sink (all rows produced,
rollups, forest fit, forest score, flag + z-score explanation, report tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    from adlens.session import get_spark
    from adlens.operators.iforest import IsolationForest
    from adlens.plans.catalog import QUERIES, queries
    from adlens.plans.findings_queries import FEATS, metric_facts

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                      **{"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "8g")})
    queries()

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def timed(fn) -> float:
        fn()  # warm-up
        ts = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            fn()
            ts.append(time.perf_counter() - t0)
        return statistics.median(ts)

    plan = [
        "row_metrics", "kpi_totals", "campaign_summary", "daily_metrics", "platform_share",
        "day_over_day", "campaign_day_over_day", "column_profile",
        "contamination_flag", "anomaly_explain", "anomaly_summary",
        "kpi_cards", "campaign_table", "summary_text", "chart_series",
        "recommendation_rows", "clean_paragraphs",
    ]
    out: dict[str, float] = {}
    for name in plan:
        out[name] = round(timed(lambda n=name: run(QUERIES[n](spark, sf_dir))), 3)

    facts = metric_facts(spark, sf_dir)
    holder = {}

    def fit() -> None:
        holder["m"] = IsolationForest(FEATS, n_trees=100, max_samples=256).fit(facts)

    out["forest_fit"] = round(timed(fit), 3)
    out["forest_score"] = round(timed(lambda: run(holder["m"].transform(facts).select("anomaly_score", "is_anomaly"))), 3)

    from adlens.plans.pipeline import analyze, release
    from adlens.sources.facts import ad_facts

    def full_report() -> None:
        # whole run: normalize -> metrics -> forest flag -> findings -> every report section
        tables = analyze(ad_facts(spark, sf_dir, keys=False), profile="lean", method="iforest")
        try:
            for name, df in tables.items():
                if df is not None and not name.startswith("_"):
                    run(df)
        finally:
            release(tables)

    out["full_report"] = round(timed(full_report), 3)

    rows = facts.count()
    total = round(sum(out.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": out,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows, "cpus": cpus,
        "repeats": repeats,
        "rows_per_sec": {k: round(rows / out[k]) for k in ("row_metrics", "forest_score", "full_report")
                         if out.get(k)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
