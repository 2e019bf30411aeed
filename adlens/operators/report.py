"""Report tables: KPI cards, campaign table, fixed texts, chart data, and the
text operators applied to model responses (recommendation lines, markdown
paragraphs). Page layout and pictures are not built; these tables feed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.numeric import fmt_num, fmt_plain, raw_sum, safe_ratio
from adlens.functions.text import (
    LEAN_PAD_RECOMMENDATIONS,
    STATUS_ATTENTION,
    STATUS_NORMAL,
)
from adlens.operators.rows import once, one_row
from adlens.operators.rollups import kpi_totals

# Whitespace as Python's str.strip() sees it in practice (ASCII set), written the
# same in Java and RE2 regular expressions.
WS = "[ \\t\\n\\r\\f\\x0B]"


def strip_ws(c):
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def summary_text(df: DataFrame, n_findings: DataFrame | None = None, money=raw_sum) -> DataFrame:
    """The no-model summary sentence and the status line."""
    # names are counted in a pass of their own: a distinct count beside sums has every name carry all sums through the shuffle
    out = one_row(kpi_totals(df, F.count(F.lit(1)).alias("records"), money=money), df.agg(F.count_distinct("campaign_name").alias("campaigns")))
    if n_findings is not None:
        out = one_row(out, n_findings.agg(F.count(F.lit(1)).alias("findings")))
    else:
        out = out.withColumn("findings", F.lit(0).cast("bigint"))
    return out.select(
        "records", "campaigns", "findings",
        F.concat(
            F.lit("Data contains "), F.col("records").cast("string"), F.lit(" records across "),
            F.col("campaigns").cast("string"), F.lit(" campaigns. Total revenue: $"), fmt_num("revenue", 0),
            F.lit(", Total spend: $"), fmt_num("spend", 0), F.lit(", ROI: "), fmt_plain("roi", 1), F.lit("%."),
        ).alias("summary"),
        F.when(F.col("findings") > 0, F.lit(STATUS_ATTENTION)).otherwise(F.lit(STATUS_NORMAL)).alias("status"),
    )


def chart_series(df: DataFrame, top_k: int = 10, money=raw_sum) -> DataFrame:
    """K3: long table (chart, series, x, y, ord) behind the dashboard, campaign and platform charts.

    One pass over the facts: grouping sets by day, campaign and platform, whose few rows are checkpointed and feed all
    series. Rows without a date are one day of their own, first in order. Without a platform column that chart is left out.
    """
    sums = [(money(m) if m in ("revenue", "spend") else F.sum(m).cast("bigint")).alias(m) for m in ("impressions", "clicks", "revenue", "spend")]
    dims = [c for c in ("date", "campaign_name", "platform") if c in df.columns]
    every = once(df.groupingSets([[c] for c in dims], *dims).agg(*sums, *[F.grouping(c).alias(f"g_{c}") for c in dims]))
    of = lambda c: every.where(F.col(f"g_{c}") == 0)
    d = of("date").withColumn("roi", safe_ratio(F.col("revenue") - F.col("spend"), "spend", 100.0))
    values = ["impressions", "clicks", "revenue", "spend", "roi"]
    daily = d.select(F.col("date").cast("string").alias("x"), F.row_number().over(Window.orderBy("date")).alias("ord"),
                     *[F.col(c).cast("double").alias(c) for c in values]).unpivot(["x", "ord"], values, "series", "y").withColumn("chart", F.lit("dashboard"))
    cols = ["chart", "series", "x", "y", "ord"]

    def ranked(c: str, chart: str, k: int | None) -> DataFrame:
        rows = of(c).orderBy(F.desc("revenue"), c)
        rows = rows if k is None else rows.limit(k)
        return rows.select(F.lit(chart).alias("chart"), F.lit("revenue").alias("series"), F.col(c).alias("x"), F.col("revenue").cast("double").alias("y"),
                           F.row_number().over(Window.orderBy(F.desc("revenue"), c)).alias("ord"))

    out = daily.select(*cols).unionByName(ranked("campaign_name", "campaign", top_k))
    if "platform" in dims:
        out = out.unionByName(ranked("platform", "platform", None))
    return out.withColumn("ord", F.col("ord").cast("bigint"))


# --------------------------------------------------------------------------- model-response text

LINE_MODES = {
    # mode: (marker characters stripped from the left, min raw length, min trimmed length, keep k,
    #        shorten, only lines starting with a digit / '-' / bullet)
    "lean": ("0123456789.-) *", 6, 1, 4, True, False),
    "script": ("0123456789.-) ", 1, 11, 4, False, False),
    "quick": ("0123456789.-) ", 1, 1, 3, False, False),
    "wide": ("0123456789.-\u2022) ", 1, 1, 5, False, True),
}


def _lstrip_class(chars: str) -> str:
    esc = "".join("\\" + ch if ch in "-.)*^[]\\" else ch for ch in chars)
    return f"^[{esc}]+"


def recommendation_lines(texts: DataFrame, keys: list[str], text_col: str = "text", mode: str = "lean",
                         max_len: int = 80) -> DataFrame:
    """Lines of a model response turned into recommendations.

    Split on newline, drop blank lines and (lean) raw lines of 5 chars or
    fewer, strip list markers, keep the first k per text, and (lean) shorten
    lines over ``max_len`` at the last blank before ``max_len - 3`` plus '...'.
    The wide mode keeps only lines that start with a digit, '-' or a bullet
    and drops lines left empty by the stripping. The window is partitioned by
    text, so its groups are the lines of one text.
    """
    marks, min_raw, min_trim, k, shorten, lead_only = LINE_MODES[mode]
    lines = texts.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    t = strip_ws(F.col("raw"))
    kept = lines.where((F.length(t) >= min_trim) & (F.length("raw") >= min_raw)).withColumn(
        "rec", F.regexp_replace(t, _lstrip_class(marks), "")
    )
    if lead_only:
        kept = kept.where(t.rlike("^[0-9\\-\u2022]")).withColumn("rec", strip_ws(F.col("rec"))) \
            .where(F.length("rec") > 0)
    w = Window.partitionBy(*keys).orderBy("line_no")
    first = kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    cut = F.substring("rec", 1, max_len - 3)
    short = F.when(F.instr(cut, " ") > 0, F.regexp_extract(cut, "^(.*) ", 1)).otherwise(cut)
    rec = F.when(F.length("rec") > max_len, F.concat(short, F.lit("..."))).otherwise(F.col("rec")) \
        if shorten else F.col("rec")
    return first.select(*keys, F.col("pos").cast("int").alias("pos"), rec.alias("recommendation"))


def recommendation_rows(texts: DataFrame, keys: list[str], text_col: str = "text", n: int = 4) -> DataFrame:
    """Exactly ``n`` recommendations per text, padded by position with the fixed defaults."""
    spark = texts.sparkSession
    pads = spark.createDataFrame(
        [(i + 1, LEAN_PAD_RECOMMENDATIONS[i]) for i in range(n)], "pos int, default_text string"
    )
    lines = recommendation_lines(texts, keys, text_col)
    base = texts.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("pos")).join(
        F.broadcast(pads), "pos")
    return base.join(lines, [*keys, "pos"], "left").select(
        *keys, "pos", F.coalesce("recommendation", "default_text").alias("recommendation")
    )


def clean_paragraphs(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Drop markdown marks, split on blank lines, trim, rewrite bullets."""
    clean = F.replace(F.replace(F.replace(F.col(text_col), F.lit("**"), F.lit("")), F.lit("##"), F.lit("")),
                      F.lit("# "), F.lit(""))
    parts = texts.select(*keys, F.posexplode(F.split(clean, "\n\n")).alias("pos", "para"))
    p = strip_ws(F.col("para"))
    bullet = F.col("p").startswith("- ") | F.col("p").startswith("* ")
    return parts.withColumn("p", p).where(F.length("p") > 0).select(
        *keys, F.col("pos").cast("int").alias("pos"),
        F.when(bullet, F.concat(F.lit("  - "), F.substring("p", 3, 1 << 30))).otherwise(F.col("p")).alias("paragraph"),
    )
