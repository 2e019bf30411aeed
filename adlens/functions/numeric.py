"""Column helpers for division, rounding and number text.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage codegen. Each helper has a matching SQL snippet in
``adlens.plans.sqltext`` that gives the same value in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fdiv(a, b) -> Column:
    """IEEE division: x/0 gives +inf, -inf or NaN like NumPy/Polars; nulls stay null.

    Spark 4 runs with ANSI on, where a plain ``/`` by zero raises, so the zero
    branch is spelled out (``a * inf`` is +inf, -inf, or NaN for 0 and NaN) and
    the other branch uses ``try_divide``. Each input is referenced twice only:
    these expressions are inlined into filters, where no common-subexpression
    elimination happens, so their size matters.
    """
    a = _c(a).cast("double")
    b = _c(b).cast("double")
    return F.when(b == 0, a * F.lit(INF)).otherwise(F.try_divide(a, b))


def roundn(x, n: int) -> Column:
    """round(x * 10^n) / 10^n -- equal to DuckDB's ``round(x * 10^n) / 10^n``.

    ``F.round(x, n)`` rounds the decimal text of a double and differs from DuckDB
    on a few rows in ten thousand; scaling first keeps both engines on the same
    binary operations. inf and NaN pass through.
    """
    s = float(10**n)
    return F.round(_c(x) * F.lit(s), 0) / F.lit(s)


def snap_round(x, n: int) -> Column:
    """Round to ``n`` places after snapping to ``n + 3``.

    For statistics whose exact value can sit on a tie at ``n`` places (a mean
    of values on a 0.01 grid): the snap removes last-bit noise of the
    summation order, so both engines round the same number.
    """
    return roundn(roundn(x, n + 3), n)


def round2(x) -> Column:
    return roundn(x, 2)


def safe_ratio(num, den, scale: float = 1.0) -> Column:
    """``num/den*scale if den > 0 else 0.0`` -- the guard used for all totals."""
    num = _c(num).cast("double")
    den = _c(den).cast("double")
    return F.when(den > 0, num / den * F.lit(scale)).otherwise(F.lit(0.0))


def finite_or_zero(x) -> Column:
    """null, NaN and +-inf become 0.0 (feature cleaning before the forest).

    ``abs(x) < inf`` is false for NaN and +-inf and null for null.
    """
    x = _c(x).cast("double")
    return F.coalesce(F.when(F.abs(x) < F.lit(INF), x), F.lit(0.0))


def is_finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def fmt_num(x, d: int) -> Column:
    """Python ``f"{x:,.{d}f}"`` (thousands separator)."""
    return F.format_number(_c(x).cast("double"), d)


def fmt_plain(x, d: int) -> Column:
    """Python ``f"{x:.{d}f}"`` (no separator)."""
    return F.regexp_replace(F.format_number(_c(x).cast("double"), d), ",", "")


def raw_sum(x) -> Column:
    """Sum of a money column as it is; the operators' default."""
    return F.sum(_c(x).cast("double"))


def money_sum(x) -> Column:
    """Sum of a money column, rounded to 4 places; for the registered queries only.

    The driver tables' prices have 2 decimals and their rates 2, so the true sum
    lies on a 1e-4 grid; rounding removes the order-dependent last bits of a
    distributed double sum and makes the result the same in every engine. Other
    data has no such grid, so operators take ``money`` as a parameter.
    """
    return roundn(F.sum(_c(x).cast("double")), 4)
