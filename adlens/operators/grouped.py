"""Many reports in one plan: statistics, quantile, flag, findings and tables by a report key.

Every operator here is its single-report form with the key carried along: one grouped aggregate, one join on the
key, one sort of (key, score). The number of jobs does not depend on the number of reports, and no step gathers a
report in one task: aggregates combine before the shuffle, the quantile comes from a range-partitioned sort that
splits a large report over many tasks, and joins on the key are Spark's own, broadcast by size or split when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numeric import INF, finite_or_zero, raw_sum, round2, roundn, safe_ratio
from adlens.functions.text import NO_FINDINGS_SENTENCE
from adlens.operators.rollups import INT_METRICS, MONEY_METRICS
from adlens.operators.rowid import row_index
from adlens.operators.rows import stored


def grouped_quantile(df: DataFrame, key: str, col: str, q: float) -> DataFrame:
    """(key, quantile): the exact continuous quantile of the non-null, non-NaN values of each key.

    Rows are numbered once in the order of (key, value) by a distributed sort; the wanted ranks of each key are two
    row numbers, which are joined back (written first: with their true size they are broadcast where they are few). Equal values of a key are split by their place in the input, so that a value
    with most of the rows is sorted by many tasks.
    """
    v = F.col(col).cast("double")
    rows = df.select(F.col(key).alias("k"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    numbered = row_index(rows.withColumn("at", F.monotonically_increasing_id()), "i", start=0, order_by=["k", "v", "at"]).drop("at")
    rank = (F.col("n") - 1) * F.lit(float(q))
    spans = numbered.groupBy("k").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "k", (F.col("first") + F.floor(rank)).alias("lo"), (F.col("first") + F.ceil(rank)).alias("hi"), (rank - F.floor(rank)).alias("part"))
    wanted = spans.select(F.col("k").alias("of"), "part", F.explode(F.array(
        F.struct(F.col("lo").alias("i"), F.lit(0).alias("upper")), F.struct(F.col("hi").alias("i"), F.lit(1).alias("upper")))).alias("w")).select("of", "part", "w.*")
    ends = numbered.join(stored(wanted, "report-ranks"), "i").groupBy("of").agg(
        F.first("part").alias("part"), F.max(F.when(F.col("upper") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("upper") == 1, F.col("v"))).alias("b"))
    return ends.select(F.col("of").alias(key), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def report_stats(df: DataFrame, key: str, feats: list[str]) -> DataFrame:
    """One row for each report, from one aggregate: rows, whether the guard holds what it needs, and for each feature
    the mean and std of the cleaned and of the finite values (as ``feature_stats`` gives them)."""
    aggs, all_clean = [F.count(F.lit(1)).alias("n")], [finite_or_zero(c) for c in feats]
    for c in feats:
        x, clean = F.col(c).cast("double"), finite_or_zero(c)
        fin = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)
        aggs += [F.avg(clean).alias(f"{c}__cm"), F.stddev_pop(clean).alias(f"{c}__cs"), F.avg(fin).alias(f"{c}__m"), F.stddev_pop(fin).alias(f"{c}__s"),
                 F.count_if(x == F.lit(INF)).alias(f"{c}__pi"), F.count_if(x == F.lit(-INF)).alias(f"{c}__ni")]
    end = lambda f: f(*all_clean) if len(feats) > 1 else all_clean[0]
    one = df.groupBy(key).agg(*aggs, F.min(end(F.least)).alias("__lo"), F.max(end(F.greatest)).alias("__hi"))
    # one row for each report, read by the flag and the findings: with its true size it is broadcast where it is small
    return stored(one.withColumn("spread", F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))).drop("__lo", "__hi"), "report-stats")


def metric_stats(stats: DataFrame, key: str, feats: list[str]) -> DataFrame:
    """(key, metric, mean, std) of the finite values, in the form that ``explain_findings`` reads."""
    nan, rows = F.lit(float("nan")), []
    for c in feats:
        pi, ni = F.col(f"{c}__pi") > 0, F.col(f"{c}__ni") > 0
        mean = F.when(pi & ni, nan).when(pi, F.lit(INF)).when(ni, F.lit(-INF)).otherwise(F.col(f"{c}__m"))
        rows.append(F.struct(F.lit(c).alias("metric"), mean.alias("mean"), F.when(pi | ni, nan).otherwise(F.col(f"{c}__s")).alias("std")))
    return stats.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def flag_reports(df: DataFrame, key: str, feats: list[str], stats: DataFrame, contamination: float = 0.1, min_rows: int = 10, guard: bool = True,
                 places: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The z-sum score, its threshold in the row's report, and the flag. A report that fails the guard flags nothing.

    Scores are worked out once and written; the sort by report, its sample and the flag read them (a score in a filter
    is inlined with all its parts, again for each reference). ``keep``: columns of ``df`` to return beside the key, default all.
    """
    clean = [f"{c}__{e}" for c in feats for e in ("cm", "cs")]
    j = df.join(stats.select(key, "n", "spread", *clean), key)
    total = None
    for c in feats:
        m, s = F.col(f"{c}__cm"), F.col(f"{c}__cs")
        z = F.when(s.isNull() | (s == 0) | F.isnan(s), 0.0).otherwise((finite_or_zero(c) - m) / s)
        total = F.pow(z, F.lit(2.0)) if total is None else total + F.pow(z, F.lit(2.0))
    fine = (F.col("n") >= min_rows) & F.col("spread") if guard else F.lit(True)
    kept = [key, *[c for c in (df.columns if keep is None else keep) if c != key]]
    scored = stored(j.select(*kept, (-total if places is None else roundn(-total, places)).alias("score"), fine.alias("__fine")), "report-scores")
    limit = stored(grouped_quantile(scored.where("__fine"), key, "score", contamination).withColumnRenamed("quantile", "threshold"), "report-limits")
    out = scored.drop("__fine").join(limit, key, "left")
    return out.withColumn("is_anomaly", F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)))


def _sum(c: str, money):
    return money(c) if c in MONEY_METRICS else F.sum(c).cast("bigint")


def kpis_by_report(df: DataFrame, key: str, money=raw_sum) -> DataFrame:
    """A1 and A9 for each report: totals, ratios from the totals, rows, campaigns and the period."""
    t = df.groupBy(key).agg(
        *[F.coalesce(_sum(m, money), F.lit(0.0 if m in MONEY_METRICS else 0)).alias(m) for m in INT_METRICS + MONEY_METRICS], F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("campaign_name").alias("campaign_count"), F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("reporting_period"))
    return t.withColumns({"roi": safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0), "ctr": safe_ratio("clicks", "impressions", 100.0),
                          "conversion_rate": safe_ratio("conversions", "clicks", 100.0)})


def daily_by_report(df: DataFrame, key: str, money=raw_sum) -> DataFrame:
    """A2 and T1 for each report and day."""
    d = df.groupBy(key, "date").agg(*[_sum(m, money).alias(m) for m in INT_METRICS + MONEY_METRICS])
    return d.withColumn("roi", round2(safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0)))


def campaigns_by_report(df: DataFrame, key: str, money=raw_sum) -> DataFrame:
    """A4 for each report, with the campaign's place by revenue in its report."""
    g = df.groupBy(key, "campaign_name").agg(*[F.coalesce(_sum(m, money), F.lit(0.0 if m in MONEY_METRICS else 0)).alias(m) for m in INT_METRICS + MONEY_METRICS])
    order = Window.partitionBy(key).orderBy(F.desc("revenue"), "campaign_name")
    return g.withColumns({"ctr": round2(safe_ratio("clicks", "impressions", 100.0)), "roi": roundn(safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0), 1),
                          "place": F.row_number().over(order)})


def platforms_by_report(df: DataFrame, key: str, money=raw_sum) -> DataFrame:
    """A8 for each report: the shares of its platforms in its impressions and revenue."""
    g = df.groupBy(key, "platform").agg(_sum("impressions", money).alias("impressions"), _sum("revenue", money).alias("revenue"))
    every = Window.partitionBy(key)
    return g.withColumns({"impressions_pct": safe_ratio(F.col("impressions"), F.sum("impressions").over(every), 100.0),
                          "revenue_pct": safe_ratio(F.col("revenue"), F.sum("revenue").over(every), 100.0)})


def texts_by_report(findings: DataFrame, reports: DataFrame, key: str, k: int = 5) -> DataFrame:
    """R7 for each row of ``reports``: the count of its findings and the first ``k`` texts, or the fixed sentence.

    The findings are written once, and read for the counts and for the first texts.
    """
    findings = stored(findings.select(key, "z", "date", "campaign_name", "metric", "value", "description"), "report-findings")
    order = Window.partitionBy(key).orderBy(F.desc("z"), "date", "campaign_name", "metric", "value")
    first = findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    bullets = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "description"))),
                                                              lambda s: F.concat(F.lit("- "), s["description"])), "\n").alias("bullets"))
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(bullets, key)
    head = F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" anomalies detected:**\n\n"), F.col("bullets"), F.lit("\n"))
    return reports.select(key).join(found, key, "left").select(
        key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.when(F.col("n") > 0, head), F.lit(NO_FINDINGS_SENTENCE)).alias("text"))
