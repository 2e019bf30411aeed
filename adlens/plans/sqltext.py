"""DuckDB SQL pieces for the oracle side of every registered query.

Each snippet states the same arithmetic as the matching helper in
``adlens.functions.numeric`` so both engines perform identical binary
operations (see the helpers for why).
"""

from __future__ import annotations

AD_FACTS_SQL = """
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS date,
       concat('C', CAST(l.l_suppkey AS VARCHAR)) AS campaign_id, s.s_name AS campaign_name,
       CAST(floor(l.l_extendedprice) AS BIGINT) AS impressions,
       CAST(l.l_quantity AS BIGINT) * 10 AS clicks,
       CAST(l.l_linenumber - 1 AS BIGINT) AS conversions,
       l.l_extendedprice * l.l_discount AS spend, l.l_extendedprice * l.l_tax AS revenue,
       r.r_name AS region, o.o_orderpriority AS platform
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def fdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))"


def roundn(x: str, n: int) -> str:
    s = float(10**n)
    return f"(round(({x}) * {s!r}) / {s!r})"


def snap_round(x: str, n: int) -> str:
    return roundn(roundn(x, n + 3), n)


def round2(x: str) -> str:
    return roundn(x, 2)


def money_sum(x: str) -> str:
    return roundn(f"sum({x})", 4)


def isum(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def safe_ratio(num: str, den: str, scale: float = 1.0) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * {scale!r} ELSE 0.0 END)"


def fmt_num(x: str, d: int) -> str:
    return f"format('{{:,.{d}f}}', CAST({x} AS DOUBLE))"


def fmt_plain(x: str, d: int) -> str:
    return f"format('{{:.{d}f}}', CAST({x} AS DOUBLE))"


def finite_or_zero(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END)"


def with_ctes(body: str, **ctes: str) -> str:
    parts = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {parts}\n{body}"


ROW_METRICS_COLS = (
    f"{round2(fdiv('clicks', 'impressions') + ' * 100')} AS ctr, "
    f"{round2(fdiv('conversions', 'clicks') + ' * 100')} AS conversion_rate, "
    f"{round2(fdiv('spend', 'conversions'))} AS cpa, "
    f"{round2(fdiv('revenue - spend', 'spend') + ' * 100')} AS roi, "
    f"{round2(fdiv('revenue', 'spend'))} AS roas"
)

METRICS_SQL = f"SELECT *, {ROW_METRICS_COLS} FROM ad_facts"
