"""The report variants beside the lean page: cards, tables, alert lines, texts and the context document.

Each form differs from the others in labels, bands, lengths and counts only, so a
form is a row of settings and one plan serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.numeric import fmt_num, fmt_plain, raw_sum, safe_ratio
from adlens.functions.text import (
    ALERT_HEADERS,
    CARD_FORMS,
    NO_FINDINGS_SHORT,
    STATUS_ATTENTION,
    STATUS_NORMAL,
    SUMMARY_OVERVIEW,
    SUMMARY_STATUS,
    WIDE_DEFAULT_RECOMMENDATIONS,
    WIDE_PAGE_RECOMMENDATIONS,
    title_from_metric,
)
from adlens.operators.explain import alert_summary
from adlens.operators.report import recommendation_lines, strip_ws
from adlens.operators.rollups import campaign_rollup, campaign_summary
from adlens.operators.rows import once, one_row

#: R1 bands of the ROI card: (above, band) in order, then the band of the rest.
BANDS = {"lean": ([(50, "good"), (0, "warn")], "bad"), "slides": ([(50, "good")], "bad"), "wide": ([(100, "good")], "warn"), "script": ([], None)}
#: R2: rows (None: all), name length (None: whole), digits of the ROI, the column before it (None: no such column).
TABLES = {"lean": (8, 18, 0, "spend"), "script": (None, 15, 1, "spend"), "wide": (10, 18, 1, "ctr"), "quick": (None, None, 0, None)}
#: Findings shown, length of the text, what stands before it.
ALERTS = {"lean": (4, 70, "* "), "slides": (3, 75, "  -  "), "script": (3, 70, ""), "wide": (5, 80, ""), "quick": (4, 75, "")}


def kpi_cards(kpis: DataFrame, form: str) -> DataFrame:
    """Six cards of a form (ordinal, label, value, subtitle, band)."""
    roi = F.col("roi")
    values = [fmt_num("impressions", 0), fmt_num("clicks", 0), fmt_num("conversions", 0), F.concat(F.lit("$"), fmt_num("revenue", 0)),
              F.concat(F.lit("$"), fmt_num("spend", 0)), F.concat(fmt_plain(roi, 1), F.lit("%"))]
    steps, rest = BANDS[form]
    band = F.lit(rest)
    for above, name in reversed(steps):
        band = F.when(roi > above, name).otherwise(band)
    cards = []
    for i, ((label, sub), value) in enumerate(zip(CARD_FORMS[form], values, strict=True)):
        text = F.lit(sub) if sub is None or "{ctr}" not in sub else F.concat(F.lit(sub.split("{ctr}")[0]), fmt_plain("ctr", 2), F.lit(sub.split("{ctr}")[1]))
        cards.append(F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("label"), value.alias("value"), text.cast("string").alias("subtitle"),
                              (band if i == 5 else F.lit(None if rest is None else "neutral")).cast("string").alias("band")))
    return kpis.select(F.explode(F.array(*cards)).alias("c")).select("c.*")


def campaign_table(df: DataFrame, form: str, money=raw_sum) -> DataFrame:
    """R2: campaigns by revenue as display text; the limit, where there is one, is the feature."""
    k, cut, digits, before = TABLES[form]
    top = campaign_rollup(df, money)
    top = top if k is None else top.limit(k)
    roi = safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0)
    more = {"ctr": [F.concat(fmt_plain(safe_ratio("clicks", "impressions", 100.0), 2), F.lit("%")).alias("ctr")],
            "spend": [F.concat(F.lit("$"), fmt_num("spend", 0)).alias("spend")], None: []}[before]
    return top.select(
        "campaign_name", (F.col("campaign_name") if cut is None else F.substring("campaign_name", 1, cut)).alias("name"),
        fmt_num("impressions", 0).alias("impressions"), fmt_num("clicks", 0).alias("clicks"),
        F.concat(F.lit("$"), fmt_num("revenue", 0)).alias("revenue"), *more, F.concat(fmt_plain(roi, digits), F.lit("%")).alias("roi"))


def alert_lines(findings: DataFrame, form: str) -> DataFrame:
    """The header with the count of all findings, then the first few texts, cut to the form's length.

    The wide form adds to each finding its title (campaign and metric) and its badge (the severity in capitals).
    """
    k, cut, mark = ALERTS[form]
    findings = once(findings)
    header = findings.agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit(0).alias("pos"), _filled(ALERT_HEADERS[form], {"n": F.col("n")}).alias("line"))
    title = F.concat(F.coalesce("campaign_name", F.lit("Unknown")), F.lit(" - "), title_from_metric(F.col("metric")))
    order = [F.desc("z"), F.col("date"), F.col("campaign_name"), F.col("metric"), F.col("value")]
    first = findings.orderBy(*order).limit(k)  # at most k rows from here on
    keys = F.array_sort(F.collect_list(F.struct(
        (-F.col("z")).alias("o1"), F.col("date").alias("o2"), F.col("campaign_name").alias("o3"), F.col("metric").alias("o4"), F.col("value").alias("o5"),
        F.col("description").alias("d"), title.alias("title"), F.upper("severity").alias("badge"))))
    more = [F.col("s.title"), F.col("s.badge")] if form == "wide" else []
    lines = first.agg(keys.alias("f")).select(F.posexplode("f").alias("i", "s")).select(
        (F.col("i") + 1).alias("pos"), F.concat(F.lit(mark), F.substring("s.d", 1, cut)).alias("line"), *more)
    return header.unionByName(lines, allowMissingColumns=True)


def quick_alerts(flagged: DataFrame) -> DataFrame:
    """D12, quick form: one alert for each flagged row, the region in brackets (Unknown where there is none)."""
    region = F.coalesce(F.col("region"), F.lit("Unknown"))
    return flagged.where("is_anomaly").select(
        "campaign_name", "date", region.alias("region"), F.concat(alert_summary(), F.lit(" ("), region, F.lit(")")).alias("description"))


def _filled(template: str, values: dict) -> F.Column:
    """A template with {names} as one text column."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def overview_text(kpis: DataFrame) -> DataFrame:
    """R6, wide page: the overview of all totals."""
    money = lambda c: F.concat(F.lit("$"), fmt_num(c, 2))
    values = {"impressions": fmt_num("impressions", 0), "clicks": fmt_num("clicks", 0), "conversions": fmt_num("conversions", 0),
              "revenue": money("revenue"), "spend": money("spend"), "roi": F.concat(fmt_plain("roi", 1), F.lit("%"))}
    return kpis.select(_filled(SUMMARY_OVERVIEW, values).alias("summary"))


def status_text(df: DataFrame, findings: DataFrame) -> DataFrame:
    """R6, wide analysis: record and finding counts and the status line."""
    one = one_row(df.agg(F.count(F.lit(1)).alias("records")), findings.agg(F.count(F.lit(1)).alias("findings")))
    status = F.when(F.col("findings") > 0, STATUS_ATTENTION).otherwise(STATUS_NORMAL)
    return one.select("records", "findings", _filled(SUMMARY_STATUS, {
        "records": fmt_num("records", 0), "findings": F.col("findings").cast("string"), "status": status}).alias("summary"))


def findings_short(findings: DataFrame, k: int = 5) -> DataFrame:
    """R7, wide analysis: the short sentence without findings, else the count and the first texts."""
    from adlens.operators.explain import findings_text
    return findings_text(findings, k).select("n", F.when(F.col("n") == 0, NO_FINDINGS_SHORT).otherwise(F.col("text")).alias("text"))


def valid_recommendations(recs: DataFrame, keys: list[str], min_len: int = 4, k: int = 4) -> DataFrame:
    """Recommendations with at least ``min_len`` characters after trimming (4 on slides, 3 on pages), the first k of each text."""
    from pyspark.sql import Window
    ok = recs.where(F.length(strip_ws(F.col("recommendation"))) >= min_len)
    return ok.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("n") <= k).drop("n")


def wide_recommendations(texts: DataFrame, keys: list[str], text_col: str = "text", page: bool = False) -> DataFrame:
    """R8/R10, wide: the first five list lines of each text, or the fixed list where a text has none."""
    default = WIDE_PAGE_RECOMMENDATIONS if page else WIDE_DEFAULT_RECOMMENDATIONS
    lines = recommendation_lines(texts, keys, text_col, mode="wide")
    has = lines.select(*keys).distinct()
    fixed = texts.select(*keys).distinct().join(has, keys, "left_anti").select(*keys, F.posexplode(F.array(*[F.lit(x) for x in default])).alias("p", "recommendation"))
    return lines.unionByName(fixed.select(*keys, (F.col("p") + 1).alias("pos"), "recommendation"))


def context_document(df: DataFrame, findings: DataFrame, kpis: DataFrame, k: int = 10, money=raw_sum) -> DataFrame:
    """One JSON document: period, metrics, campaigns by revenue, finding summary and the first findings.

    ``kpis``: one row of totals with total_records, campaign_count and reporting_period. Campaigns are
    limited to ``k`` of highest revenue and details to ``k`` findings, as the document is a prompt; the
    list of affected campaigns is complete.
    """
    findings = once(findings)
    top = campaign_summary(df, money).limit(k)
    perf = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("o"), F.col("campaign_name").alias("name"), "revenue", "roi"))).alias("t")).select(
        F.transform("t", lambda s: F.struct(s["name"].alias("name"), s["revenue"].alias("revenue"), s["roi"].alias("roi"))).alias("top_campaigns"))
    about = findings.agg(F.count(F.lit(1)).alias("total_anomalies"), F.count_if(F.col("severity") == "high").alias("high_severity"),
                         F.array_sort(F.collect_set("campaign_name")).alias("affected_campaigns"))
    first = findings.orderBy(F.desc("z"), "date", "campaign_name", "metric", "value").limit(k).agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("z")).alias("o1"), F.col("date").cast("string").alias("date"), "campaign_name", "metric", "value", "campaign_id",
            F.array("expected_lo", "expected_hi").alias("expected_range"), "severity", "description"))).alias("d")).select(
        F.transform("d", lambda s: s.dropFields("o1")).alias("anomaly_details"))
    row = one_row(kpis, perf, about, first)
    return row.select(F.to_json(F.struct(
        "reporting_period", "total_records",
        F.struct(F.col("impressions").alias("total_impressions"), F.col("clicks").alias("total_clicks"), F.col("conversions").alias("total_conversions"),
                 F.col("spend").alias("total_spend"), F.col("revenue").alias("total_revenue"), F.col("ctr").alias("average_ctr"), F.col("roi").alias("average_roi")).alias("metrics"),
        "campaign_count", "top_campaigns",
        F.struct("total_anomalies", "high_severity", "affected_campaigns").alias("anomaly_summary"), "anomaly_details")).alias("context"))


def context_lists(df: DataFrame, findings: DataFrame, k: int = 10, money=raw_sum, sep: str = "|") -> list[DataFrame]:
    """R9 in flat form: the document's lists as one text each, in tables of one row.

    The ``k`` campaigns of highest revenue with their figures, the sorted names of all affected campaigns (A12), and
    the texts of the first ``k`` findings (L3). ``findings`` is read twice.
    """
    line = F.concat(F.coalesce("campaign_name", F.lit("Unknown Campaign")), F.lit(": $"), fmt_num("revenue", 2), F.lit(", ROI "), fmt_plain("roi", 1), F.lit("%"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["line"]), sep)
    top = campaign_summary(df, money).limit(k).agg(joined(F.struct((-F.col("revenue")).alias("o"), "campaign_name", line.alias("line"))).alias("top_campaigns"))
    names = findings.select("campaign_name").distinct().agg(F.array_join(F.array_sort(F.collect_list("campaign_name")), sep).alias("affected_campaign_names"))
    first = findings.orderBy(F.desc("z"), "date", "campaign_name", "metric", "value").limit(k).agg(
        joined(F.struct((-F.col("z")).alias("o"), "date", "campaign_name", "metric", "value", F.col("description").alias("line"))).alias("anomaly_details"))
    return [top, names, first]
