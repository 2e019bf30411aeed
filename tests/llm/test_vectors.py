"""Hard negatives and centroid clusters against brute force, awkward vectors, exactness of both products."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import centroids as C
from adlens.llm import hard_negatives as H

NAN, INF = float("nan"), float("inf")


def naive_negatives(rows, positives, negatives, low=30, high=90):
    """rows: (id, label, integer vector); anchors: ids divisible by 100."""
    out = []
    for a, la, qa in rows:
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q, strict=True)), i, lab) for i, lab, q in rows if i != a)
        for ps, p, _ in [t for t in s if t[2] == la][:positives]:
            band = [t for t in s if t[2] != la and low * -ps <= 100 * -t[0] <= high * -ps][:negatives]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(band, 1)]
    return sorted(out)


def as_frame(spark, rows, dim_type="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding {dim_type}, score string, block int, q string")


@pytest.mark.parametrize("field, size", [(4, 300), (8, 3_000_000)])
def test_fields_hold_exact_products(field, size):
    rng = np.random.default_rng(4)
    q = rng.integers(-size, size + 1, (57, 9))
    bias, width = H.field_bytes(int(q.min()), int(q.max()), 9)
    assert width == field
    packed = H.Packed(q, bias, width)
    for a in q[:10]:
        assert packed.scores(a).tolist() == (q @ a).tolist()
    with pytest.raises(ValueError):
        H.field_bytes(-(1 << 30), 1 << 30, 64)


def test_hard_negatives_of_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)) if i % 5 else 0, [float(x) for x in rng.choice([-0.5, 0.25, 0.75, 1.0], 6)]) for i in range(0, 900, 3)]
    clean = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    rows += [(901, None, [1.0] * 6), (902, 1, None), (903, 1, [NAN] + [1.0] * 5), (904, 1, [None] + [1.0] * 5), (905, 1, [INF] + [1.0] * 5), (None, 1, [1.0] * 6),
             (907, 1, []), (908, 1, [1.0] * 5), (1000, 9, [1.0] * 6), rows[0], rows[4]]
    clean += [(1000, 9, [256] * 6)]
    df = as_frame(spark, [(*r, "clash", 1, "q") for r in rows])
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), positives=4, negatives=7, block_rows=64, block_anchors=2)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == naive_negatives(clean, 4, 7)
    assert H.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert H.hard_negatives(df, F.col("vec_id") < 0, F.col("label")).count() == 0


def test_negative_and_zero_scores_have_no_or_a_zero_band(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [-0.5, 0.0]), (4, 2, [0.0, 2.0]), (5, 2, [1.0, 1.0])]
    got = H.hard_negatives(as_frame(spark, [(*r, "", 0, "") for r in rows]), F.col("vec_id") % 100 == 0, F.col("label"))
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in got.collect()] == [(2, 4, 0)]


def naive_clusters(rows, k, rounds, seed=1):
    q = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, q, strict=True) if i is not None)
    cent = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        own = [near(v)[1] for v in q]
        for j in range(len(cent)):
            mine = [v for v, o in zip(q, own, strict=True) if o == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for (i, _), v in zip(rows, q, strict=True)], cent


def test_transform_is_exact_and_search_is_complete():
    rng = np.random.default_rng(2)
    for size in (1, 3, 40, 1 << 24):  # small sizes: many ties; the largest needs Python's integers
        x, c = rng.integers(-size, size + 1, (300, 64)), rng.integers(-size, size + 1, (16, 64))
        c[5] = c[2]
        kind = object if size > 1 << 20 else np.int64
        x, c = x.astype(kind), c.astype(kind)
        far = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        number, distance, _ = C.search(C.transform(x), C.transform(c))
        assert distance.tolist() == far.min(axis=1).tolist()
        assert number.tolist() == [row.tolist().index(min(row.tolist())) for row in far]
    changes = [sum(a != b for a, b in zip(r[1:], r[:-1], strict=True)) for r in np.sign(C.transform(np.eye(64, dtype=np.int64))).T.tolist()]
    assert changes == list(range(64))  # coarse to fine


def test_elimination_saves_coefficients():
    rng = np.random.default_rng(3)
    smooth = rng.integers(-40, 41, (16, 8)).repeat(8, axis=1)
    x = smooth[rng.integers(0, 16, 500)] + rng.integers(-2, 3, (500, 64))
    _, _, work = C.search(C.transform(x), C.transform(smooth))
    assert work < 500 * 16 * 64 / 2


@pytest.mark.parametrize("scale", [1.0, 40_000.0])
def test_clusters_of_awkward_vectors(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (rng.integers(-3, 4, 64) / 8 + (i % 4)) * scale]) for i in range(120)] + [(None, [0.25] * 64)]
    rows += [rows[7], rows[7]]  # repeated rows count as often as they occur
    want, cent = naive_clusters(rows, 5, 3)
    bad = [(500, None), (501, []), (502, [1.0] * 63), (503, [NAN] + [1.0] * 63), (504, [INF] + [1.0] * 63), (505, [None] + [1.0] * 63), (506, [1.0] * 65)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, cluster int, distance string")
    assigned, got = C.cluster_vectors(df, k=5)
    assert got == cent
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted(want, key=key)
    report = C.centroid_report(spark, assigned, got).collect()
    assert {r.inertia for r in report} == {sum(d for _, _, d in want)}
    for r in report:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cent[r.cluster])).encode()).hexdigest()


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(3, [0.5] * 64), (4, [-0.5] * 64)], "vec_id long, embedding array<float>")
    assigned, got = C.cluster_vectors(df)
    assert len(got) == 2 and {r.distance for r in assigned.collect()} == {0}
    none, got = C.cluster_vectors(df.limit(0))
    assert not got and C.centroid_report(spark, none, got).count() == 0
    with pytest.raises(ValueError):
        C.cluster_vectors(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))
