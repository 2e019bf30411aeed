"""Isolation forest: properties only (other random numbers than any other implementation)."""

import math

import numpy as np
from pyspark.sql import functions as F

from adlens.operators.detect import detect
from adlens.operators.iforest import IsolationForest, IsolationForestModel, avg_path_length
from adlens.plans.findings_queries import FEATS, metric_facts


def test_avg_path_length_values():
    c = avg_path_length([0, 1, 2, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1.0
    assert math.isclose(c[3], 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256)


def test_share_and_repeatability(spark, sf_small):
    df = metric_facts(spark, sf_small)
    m1 = IsolationForest(FEATS, n_trees=10, seed=7).fit(df)  # fewer places than rows: the pool is a sample
    m2 = IsolationForest(FEATS, n_trees=10, seed=7).fit(df.repartition(5).orderBy("revenue"))
    assert m1.nodes.equals(m2.nodes)
    assert m1.offset == m2.offset == m1.fit_offset(df)
    n = df.count()
    flagged = m1.transform(df).where("is_anomaly").count()
    assert flagged <= math.ceil(0.1 * n) + 1
    assert flagged >= 0.08 * n


def test_repeated_rows_are_drawn_as_often_as_any_others(spark):
    # one vector makes up half of the table
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("f0")).checkpoint()
    for seed in range(10):
        est = IsolationForest(["f0"], n_trees=10, max_samples=256, seed=seed)
        pool = est._pool(est._counts(df))
        assert abs(len(pool) - 2560) < 5 * 2560**0.5
        assert abs((pool[:, 0] == 5.0).mean() - 0.5) < 0.05  # five standard errors


def test_weighted_quantile_equals_that_of_the_rows(spark):
    from adlens.operators.quantile import exact_quantile
    few = spark.range(60).select((F.col("id") * 37 % 23).cast("double").alias("v"), (F.col("id") % 5 + 1).alias("n"))
    rows = few.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    for q in (0.0, 0.1, 0.37, 0.5, 1.0):
        assert exact_quantile(few, "v", q, buckets=4, weight="n") == exact_quantile(rows, "v", q)


def test_planted_outliers_are_flagged(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in rng.normal(0, 1, size=(2000, 2))]
    rows += [(40.0, -40.0), (-35.0, 38.0), (50.0, 50.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    out = IsolationForest(["x", "y"], n_trees=50, contamination=0.05).fit(df).transform(df)
    got = {(r.x, r.y) for r in out.where("is_anomaly").collect()}
    assert {(40.0, -40.0), (-35.0, 38.0), (50.0, 50.0)} <= got


def test_small_input_replicates_rows_per_tree(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(300)], "x double, y double")
    m = IsolationForest(["x", "y"], n_trees=20, max_samples=256).fit(df)
    assert m.psi == 256
    assert m.nodes.groupby("tree")["size"].max().eq(256).all()


def test_guard_blocks_tiny_and_constant(spark):
    nine = spark.createDataFrame([(float(i), float(i)) for i in range(9)], "impressions double, clicks double")
    assert detect(nine, "iforest", ["impressions", "clicks"]).where("is_anomaly").count() == 0
    const = spark.createDataFrame([(5.0, 5.0)] * 10, "impressions double, clicks double")
    assert detect(const, "iforest", ["impressions", "clicks"]).where("is_anomaly").count() == 0
    assert detect(const, "zsum", ["impressions", "clicks"]).where("is_anomaly").count() == 0


def test_save_load_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(float(i), float((i * 37) % 11)) for i in range(500)], "x double, y double")
    m = IsolationForest(["x", "y"], n_trees=10).fit(df)
    m.save(spark, tmp_dir + "/model")
    m2 = IsolationForestModel.load(spark, tmp_dir + "/model")
    a = [r.anomaly_score for r in m.transform(df).orderBy("x").collect()]
    b = [r.anomaly_score for r in m2.transform(df).orderBy("x").collect()]
    assert a == b


def test_zsum_flag_share(spark, sf_small):
    df = metric_facts(spark, sf_small)
    out = detect(df, "zsum", FEATS)
    n = out.count()
    k = out.where("is_anomaly").count()
    assert 0 < k <= math.ceil(0.1 * n)
    assert out.where(F.col("is_anomaly") != (F.col("anomaly_score") < 0)).count() == 0


def test_sketch_threshold_path(spark, sf_small):
    df = metric_facts(spark, sf_small)
    n = df.count()
    for method in ("zsum", "iforest"):
        k = detect(df, method, FEATS, exact=False, n_trees=20).where("is_anomaly").count()
        assert 0.08 * n <= k <= 0.12 * n, (method, k)
