"""Fixed texts of the reports and small text column helpers.

FIXED VALUES -- these strings must equal the reference's output text, so they
are stated here as plain text, in the reference's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: display name per metric (finding descriptions) ----
METRIC_DISPLAY_NAMES = {
    "impressions": "Impressions",
    "clicks": "Clicks",
    "conversions": "Conversions",
    "spend": "Ad Spend",
    "revenue": "Revenue",
    "ctr": "Click-Through Rate (CTR)",
    "conversion_rate": "Conversion Rate",
    "cpa": "Cost Per Acquisition (CPA)",
    "roi": "Return on Investment (ROI)",
    "roas": "Return on Ad Spend (ROAS)",
}

# ---- fixed values: recommendations used when no model text is available ----
LEAN_DEFAULT_RECOMMENDATIONS = [
    "Review campaign performance",
    "Investigate anomalies",
    "Optimize underperforming campaigns",
    "Scale successful campaigns",
]
LEAN_PAD_RECOMMENDATIONS = [
    "Optimize high-spend low-ROI campaigns",
    "Scale top performers",
    "Review anomalies",
    "A/B test creatives",
]
WIDE_DEFAULT_RECOMMENDATIONS = [
    "Review campaigns with detected anomalies for potential optimization opportunities",
    "Monitor underperforming campaigns closely over the next week",
    "Consider A/B testing ad creatives for campaigns with declining CTR",
    "Analyze high-performing campaigns to replicate success factors",
]

# ---- fixed values: sentences of the no-model path ----
NO_FINDINGS_SENTENCE = (
    "No significant anomalies were detected during the reporting period. All metrics are within expected ranges."
)
NO_FINDINGS_SHORT = "No anomalies detected."
STATUS_ATTENTION = "Attention needed - anomalies detected"
STATUS_NORMAL = "All metrics within normal range"

# ---- fixed values: KPI card labels and subtitles of each form ({ctr}: the click rate) ----
CARD_FORMS = {
    "lean": [("IMPRESSIONS", "Total ad views"), ("CLICKS", "CTR: {ctr}%"), ("CONVERSIONS", "Completed actions"),
             ("REVENUE", "Total earnings"), ("AD SPEND", "Investment"), ("ROI", "Return on investment")],
    "slides": [("IMPRESSIONS", "Total ad views delivered"), ("CLICKS", "Click-through rate: {ctr}%"),
               ("CONVERSIONS", "Completed actions"), ("REVENUE", "Total earnings generated"),
               ("AD SPEND", "Marketing investment"), ("ROI", "Return on investment")],
    "wide": [("Total Impressions", None), ("Total Clicks", None), ("Total Conversions", None), ("Total Revenue", None),
             ("Total Spend", None), ("Overall ROI", None)],
    "script": [("Impressions", None), ("Clicks", None), ("Conversions", None), ("Revenue", None), ("Spend", None),
               ("ROI", None)],
}

# ---- fixed values: header of the alert lines of each form ----
ALERT_HEADERS = {
    "lean": "ANOMALIES DETECTED ({n})",
    "slides": "ANOMALIES DETECTED: {n} unusual patterns identified",
    "script": "Anomaly Alerts ({n} detected)",
    "wide": "{n} anomalies detected during the reporting period:",
    "quick": "ANOMALIES DETECTED ({n})",
}

# ---- fixed values: the wide page's recommendations ----
WIDE_PAGE_RECOMMENDATIONS = [
    "Review campaigns with detected anomalies for potential optimization",
    "Monitor underperforming campaigns closely over the next week",
    "Consider A/B testing ad creatives for campaigns with declining CTR",
    "Analyze high-performing campaigns to replicate success factors",
    "Review budget allocation based on ROI performance",
]

# ---- fixed values: the wide summaries (the status line without its marks, which text sinks drop) ----
SUMMARY_OVERVIEW = """## Performance Overview

This automated report provides an analysis of your advertising campaign performance.

**Key Metrics:**
- Total Impressions: {impressions}
- Total Clicks: {clicks}
- Total Conversions: {conversions}
- Total Revenue: {revenue}
- Total Spend: {spend}
- Overall ROI: {roi}

**Summary:**
The campaigns generated {revenue} in revenue against {spend} in ad spend, 
resulting in a {roi} return on investment.

Please review the detailed charts and anomaly analysis below for more insights.
"""
SUMMARY_STATUS = """## Executive Summary

This report covers the performance analysis of your advertising campaigns.

**Key Metrics:**
- Total records analyzed: {records}
- Anomalies detected: {findings}

**Status:** {status}

Please review the detailed charts and anomaly analysis below for more information.
"""


def display_name(metric: Column) -> Column:
    """Metric -> display text; unknown metrics keep their name."""
    m = F.create_map(*[F.lit(x) for kv in METRIC_DISPLAY_NAMES.items() for x in kv])
    return F.coalesce(m[metric], metric)


def title_from_metric(metric: Column) -> Column:
    """``_`` -> blank, then capitalise each word."""
    return F.initcap(F.regexp_replace(metric, "_", " "))


def report_title(stem: Column) -> Column:
    """File stem with ``_``/``-`` as blanks, title case.

    ``initcap`` capitalises after blanks only; Python's ``title`` also after
    digits (``q3report`` -> ``Q3Report``). Documented difference.
    """
    return F.initcap(F.translate(stem, "_-", "  "))
