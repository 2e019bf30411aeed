"""Row metrics: CTR, conversion rate, CPA, ROI, ROAS.

Two zero modes:

* ``ieee`` -- x/0 is +-inf and 0/0 is NaN, as the wide pipeline carries them;
  each metric is added only if its inputs exist (conditional projection).
* ``guarded`` -- the lean pipeline's CTR and ROI: if the table total of the
  denominator is not positive the metric is 0.0 everywhere, else NaN becomes
  0 (inf and null stay). Both totals are one scalar subquery (one row).

All metrics are added in one ``withColumns`` projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.numeric import fdiv, round2

# metric -> (numerator expression inputs, denominator, scale)
RATIO_METRICS = ["ctr", "conversion_rate", "cpa", "roi", "roas"]


def _metric_exprs(cols: set[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if {"impressions", "clicks"} <= cols:
        out["ctr"] = round2(fdiv("clicks", "impressions") * 100)
    if {"conversions", "clicks"} <= cols:
        out["conversion_rate"] = round2(fdiv("conversions", "clicks") * 100)
    if {"spend", "conversions"} <= cols:
        out["cpa"] = round2(fdiv("spend", "conversions"))
    if {"revenue", "spend"} <= cols:
        out["roi"] = round2(fdiv(F.col("revenue") - F.col("spend"), "spend") * 100)
        out["roas"] = round2(fdiv("revenue", "spend"))
    return out


def row_metrics(df: DataFrame, zero_mode: str = "ieee") -> DataFrame:
    if zero_mode == "ieee":
        exprs = _metric_exprs(set(df.columns))
        return df.withColumns(exprs) if exprs else df
    if zero_mode == "guarded":
        return guarded_metrics(df)
    raise ValueError(f"zero_mode must be 'ieee' or 'guarded', not {zero_mode!r}")


def guarded_metrics(df: DataFrame) -> DataFrame:
    """Lean CTR/ROI with a table-level guard (see module doc)."""
    tot = df.select(F.struct(F.sum("impressions").alias("i"), F.sum("spend").alias("s"))).scalar()
    tot_impr, tot_spend = tot["i"], tot["s"]
    nan0 = lambda c: F.nanvl(c, F.lit(0.0))
    ctr = fdiv("clicks", "impressions") * 100
    roi = fdiv(F.col("revenue") - F.col("spend"), "spend") * 100
    return df.withColumns({
        "ctr": F.when(tot_impr > 0, round2(nan0(ctr))).otherwise(F.lit(0.0)),
        "roi": F.when(tot_spend > 0, round2(nan0(roi))).otherwise(F.lit(0.0)),
    })
