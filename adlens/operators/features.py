"""Feature assembly, feature statistics, scaling and the contamination flag.

Statistics are one aggregate pass over the facts (a few partial rows per task);
the result is one row per feature and is joined back as a broadcast, whose size
is bounded by the number of features, not by the data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.numeric import INF, finite_or_zero, roundn
from adlens.operators.quantile import approx_quantile, exact_quantile

DEFAULT_FEATURES = [
    "impressions", "clicks", "conversions", "spend", "revenue",
    "ctr", "conversion_rate", "cpa", "roi", "roas",
]


def feature_columns(df: DataFrame, feature_cols: list[str] | None = None) -> list[str]:
    """The requested features, or those of the ten default metrics present."""
    if feature_cols is not None:
        return list(feature_cols)
    return [c for c in DEFAULT_FEATURES if c in df.columns]


def feature_matrix(df: DataFrame, feature_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """D1 + M8: keep columns plus features with null/NaN/inf replaced by 0."""
    keep = keep or []
    return df.select(*keep, *[finite_or_zero(c).alias(c) for c in feature_cols])


def _finite_aggs(c: str) -> list:
    """A14's aggregates of one feature: from the finite values, plus inf counts, so that no engine does arithmetic on inf."""
    x = F.col(c).cast("double")
    fin = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)
    return [
        F.avg(fin).alias(f"{c}__fm"), F.stddev_pop(fin).alias(f"{c}__fs"),
        F.min(F.when(~F.isnan(x), x)).alias(f"{c}__lo"), F.max(F.when(~F.isnan(x), x)).alias(f"{c}__hi"),
        F.count_if(x == F.lit(INF)).alias(f"{c}__pi"), F.count_if(x == F.lit(-INF)).alias(f"{c}__ni"),
    ]


def feature_stats(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Mean, population std, min, max per feature, NaN and null skipped.

    An infinite value makes the mean +-inf (NaN if both signs occur) and the std
    NaN, as NumPy's nan-functions do; such a feature later gives no findings.
    """
    return stats_table(df.agg(*[a for c in feature_cols for a in _finite_aggs(c)]), feature_cols)


def stats_table(one: DataFrame, feature_cols: list[str]) -> DataFrame:
    """(ordinal, metric, mean, std, min, max) from a one-row table of ``_finite_aggs``."""
    nan = F.lit(float("nan"))
    rows = []
    for i, c in enumerate(feature_cols):
        pi, ni = F.col(f"{c}__pi"), F.col(f"{c}__ni")
        mean = (
            F.when((pi > 0) & (ni > 0), nan).when(pi > 0, F.lit(INF)).when(ni > 0, F.lit(-INF))
            .otherwise(F.col(f"{c}__fm"))
        )
        std = F.when((pi > 0) | (ni > 0), nan).otherwise(F.col(f"{c}__fs"))
        rows.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("metric"), mean.alias("mean"), std.alias("std"),
            F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max"),
        ))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def _clean_aggs(c: str) -> list:
    x = finite_or_zero(c)
    return [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]


def clean_stats(df: DataFrame, feature_cols: list[str]) -> dict:
    """Mean and population std of the cleaned features (one small collected row)."""
    return df.agg(*[a for c in feature_cols for a in _clean_aggs(c)]).first().asDict()


def all_stats(df: DataFrame, feature_cols: list[str], guarded: bool = True) -> tuple[dict, DataFrame]:
    """What the guard, the z-sum score and the findings need, from one pass: (a collected row, ``feature_stats``' table).

    Without ``guarded`` what only the guard needs is left out, as very many aggregates outgrow compiled code.
    """
    guard = [F.count(F.lit(1)).alias("rows")]
    for c in feature_cols if guarded else ():
        guard += [F.min(finite_or_zero(c)).alias(f"{c}__cl"), F.max(finite_or_zero(c)).alias(f"{c}__ch")]
    one = df.agg(*guard, *[a for c in feature_cols for a in _clean_aggs(c) + _finite_aggs(c)])
    row = one.first()
    return row.asDict(), stats_table(df.sparkSession.createDataFrame([row], one.schema), feature_cols)


def scale_exprs(stats_row: dict, feature_cols: list[str]) -> dict:
    """(clean(x) - mean) / std per feature, zero or missing std -> 0."""
    out = {}
    for c in feature_cols:
        m, s = stats_row[f"{c}__m"], stats_row[f"{c}__s"]
        if s is None or s == 0 or s != s:
            out[c] = F.lit(0.0)
        else:
            out[c] = (finite_or_zero(c) - F.lit(m)) / F.lit(s)
    return out


def feature_scaled(df: DataFrame, feature_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Cleaned features standardised with the population std (stats: one small row)."""
    z = scale_exprs(clean_stats(df, feature_cols), feature_cols)
    return df.select(*(keep or []), *[z[c].alias(c) for c in feature_cols])


def zsum_score(df: DataFrame, feature_cols: list[str], places: int | None = None, stats: dict | None = None) -> DataFrame:
    """Deterministic unusualness score: -(sum of squared z of the cleaned features), rounded to ``places`` if given.

    Lower = more unusual, like the forest's score; used where an oracle must
    reproduce the flag exactly. All input columns are kept. ``stats``: those of
    ``clean_stats`` or ``all_stats``, where they are known already.
    """
    z = scale_exprs(stats or clean_stats(df, feature_cols), feature_cols)
    # fold z*z left to right over an array: each z appears once in the plan
    # (``z[c] * z[c]`` would copy it, and a filter on the score gets no
    # common-subexpression elimination); same additions, same order
    total = None
    for c in feature_cols:
        sq = F.pow(z[c], F.lit(2.0))  # fdlibm pow returns x*x exactly for y = 2
        total = sq if total is None else total + sq
    return df.withColumn("score", -total if places is None else roundn(-total, places))


def contamination_threshold(scored: DataFrame, contamination: float = 0.1, score_col: str = "score",
                            exact: bool = True) -> float | None:
    """The ``contamination`` quantile of the scores (exact, or sketch for huge inputs)."""
    col = scored.select(score_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if exact:
            return exact_quantile(col, score_col, contamination)
        return approx_quantile(col, score_col, contamination)
    finally:
        col.unpersist()


def flag_by_contamination(scored: DataFrame, contamination: float = 0.1, score_col: str = "score",
                          exact: bool = True) -> DataFrame:
    """Rows below the contamination quantile are flagged; threshold kept as a column."""
    t = contamination_threshold(scored, contamination, score_col, exact)
    thr = F.lit(t).cast("double") if t is not None else F.lit(None).cast("double")
    return scored.withColumns({
        "threshold": thr,
        "is_anomaly": F.coalesce(F.col(score_col) < thr, F.lit(False)),
    })


def guard_ok(df: DataFrame, feature_cols: list[str], min_rows: int = 10, stats: dict | None = None) -> bool:
    """At least ``min_rows`` rows and some spread in the whole feature matrix."""
    if stats is None:
        ends = [a for c in feature_cols for a in (F.min(finite_or_zero(c)).alias(f"{c}__cl"), F.max(finite_or_zero(c)).alias(f"{c}__ch"))]
        stats = df.agg(F.count(F.lit(1)).alias("rows"), *ends).first().asDict()
    if stats["rows"] < min_rows or not stats["rows"]:
        return False
    return min(stats[f"{c}__cl"] for c in feature_cols) != max(stats[f"{c}__ch"] for c in feature_cols)
