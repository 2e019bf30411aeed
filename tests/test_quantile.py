"""Exact distributed quantile equals the continuous (linear) quantile, on every narrowing path."""

import numpy as np
import pytest

from adlens.operators.quantile import approx_quantile, exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.1, 0.37, 0.5, 0.9, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(0, 50, 4000), np.full(700, 3.25), rng.integers(-5, 5, 1300).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    want = float(np.quantile(vals, q))  # linear interpolation = quantile_cont
    # few buckets force many histogram passes
    for buckets in (4096, 8, 2):
        got = exact_quantile(df, "x", q, buckets=buckets)
        assert got == pytest.approx(want, rel=0, abs=1e-12), buckets


def test_empty_and_approx(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_quantile(empty, "x", 0.5) is None
    df = spark.range(0, 10001).selectExpr("cast(id as double) as x")
    assert abs(approx_quantile(df, "x", 0.1) - 1000.0) <= 5


def test_bracket_and_narrowing_give_the_same(spark):
    from pyspark.sql import functions as F

    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, 7.25).otherwise((F.xxhash64("id") % 1_000_003).cast("double")).alias("v")).persist()
    want = sorted(r.v for r in df.collect())
    for q in (0.0, 0.1, 0.25, 0.5, 0.9999, 1.0):
        at = (len(want) - 1) * q
        exact = want[int(at)] + (want[min(int(at) + 1, len(want) - 1)] - want[int(at)]) * (at % 1)
        # all values, the sketch's bracket, histogram passes
        got = [exact_quantile(df, "v", q, gather=g) for g in (200_000, 100, 0)]
        assert got[0] == got[1] == got[2] and abs(got[0] - exact) <= 1e-6 * max(1.0, abs(exact))
    df.unpersist()
