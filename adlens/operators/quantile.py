"""Exact quantile of one column without sorting or gathering the column.

``percentile`` in Spark is exact but keeps every value of a group in one
buffer, so a global percentile puts the whole column into one task. Here one
pass counts the values and brackets the wanted rank by a mergeable sketch; the
second counts what lies below the bracket and each value inside it. The bracket
holds a few ten-thousandths of the column. Where even that is more than
``GATHER`` values (or rows carry weights), the bracket is narrowed instead by
histogram passes: each is a scan with a ``groupBy(bucket)`` of at most
``buckets`` groups (partial aggregation, so the shuffle carries ``buckets`` rows
per task), the driver reads that small histogram and keeps the one bucket that
holds the rank, down to a single value. Interpolation follows the usual
continuous definition (``quantile_cont``): position (n-1)*q, linear between the
two neighbours.

Callers should persist the input column first; it is read twice or more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values that may reach the driver at once.
GATHER = 200_000
#: Rank error of the sketch is at most one in so many rows.
ACCURACY = 10_000


def _kth(df: DataFrame, col: str, k: int, lo: float, hi: float, below: int, buckets: int, weight) -> float:
    x = F.col(col)
    while True:
        if lo == hi:
            return lo
        part = df.where((x >= F.lit(lo)) & (x <= F.lit(hi)))
        width = hi - lo
        if not math.isfinite(width):
            # range too wide for a double; split on the sign first
            b = F.when(x < 0, 0).otherwise(1)
        else:
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(width) * buckets), F.lit(buckets - 1))
        hist = sorted(
            part.groupBy(b.alias("b")).agg(F.sum(weight).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
            .collect()
        )
        for row in hist:
            if below + row["n"] > k:
                lo, hi = float(row["lo"]), float(row["hi"])
                break
            below += row["n"]
        else:  # pragma: no cover - k out of range
            raise ValueError("rank outside the column")


def _in_bracket(vals: DataFrame, lo: float, hi: float, first: int, last: int) -> tuple[float, float] | None:
    """Values of the ranks ``first`` and ``last`` if both lie in the bracket, from one pass."""
    v = F.col("v")
    rows = vals.where(v <= F.lit(hi)).groupBy(F.when(v >= F.lit(lo), v).alias("v")).agg(F.sum("w").alias("n")).collect()  # GATHER rows at most
    at = sum(r["n"] for r in rows if r["v"] is None)
    if first < at:
        return None
    found = []
    for r in sorted((r for r in rows if r["v"] is not None), key=lambda r: r["v"]):
        at += r["n"]
        while len(found) < 2 and (first, last)[len(found)] < at:
            found.append(float(r["v"]))
    return (found[0], found[1]) if len(found) == 2 else None


def exact_quantile(df: DataFrame, col: str, q: float, buckets: int = 1024, weight: str | None = None, gather: int = GATHER) -> float | None:
    """Continuous quantile ``q`` of the non-null, non-NaN values of ``col``.

    ``weight``: a column that says how many equal values a row stands for. ``gather``: different values that may
    reach the driver; it bounds memory and doesn't change the result.
    """
    x, w = F.col(col).cast("double"), F.col("w")
    vals = df.select(x.alias("v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    e = 2.0 / ACCURACY
    ends = F.percentile_approx("v", [max(0.0, q - e), min(1.0, q + e)], ACCURACY) if weight is None else F.lit(None)
    st = vals.agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"), ends.alias("ends")).first()
    n = st["n"]
    if n == 0:
        return None
    rn = (n - 1) * q
    f = math.floor(rn)
    c = math.ceil(rn)
    lo, hi = float(st["lo"]), float(st["hi"])
    got = None
    if st["rows"] <= gather:
        got = _in_bracket(vals, lo, hi, f, c)
    elif st["ends"] is not None and 3 * e * st["rows"] <= gather:
        got = _in_bracket(vals, float(st["ends"][0]), float(st["ends"][1]), f, c)
    if got is not None:
        return got[0] + (got[1] - got[0]) * (rn - f)
    vf = _kth(vals, "v", f, lo, hi, 0, buckets, w)
    if c == f:
        return vf
    # the next rank: same value if enough ties, else the next larger value
    # one pass: how many values are <= vf, and the next larger value
    r = vals.agg(F.sum(F.when(F.col("v") <= F.lit(vf), w).otherwise(0)).alias("le"),
                 F.min(F.when(F.col("v") > F.lit(vf), F.col("v"))).alias("nxt")).first()
    vc = vf if r["le"] > c else float(r["nxt"])
    return vf + (vc - vf) * (rn - f)


def approx_quantile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    """Sketch-based quantile (mergeable, bounded memory); for very large inputs."""
    r = df.agg(F.percentile_approx(F.col(col).cast("double"), q, accuracy)).first()[0]
    return None if r is None else float(r)
