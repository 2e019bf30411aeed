"""Centroid clustering: Lloyd rounds on integer vectors of 64 components, exact in every distance and mean.

Method: Walsh-Hadamard progressive search. Vectors and centroids go through the exact integer Walsh-Hadamard
transform, which multiplies every squared distance by 64. Its coefficients are taken in order of sequency, coarse
to fine: squared differences are added up stage by stage, so that a sum so far never exceeds the whole. After each
stage the centroid that leads a vector's list is finished at once, which bounds the vector's least distance; every
centroid whose sum is already greater is dropped for good, equal ones stay. What is left finishes all 64.

Each round is one pass over the vectors: every task adds up its vectors by cluster, and Spark adds those sums, so
that clusters x 65 numbers reach the driver, however many vectors there are.

Defined cases: vectors of another length than 64, null vectors, and vectors with a null or non-finite component take
no part. A repeated row counts as often as it occurs. Rows without an id are clustered but never start a centroid.
With fewer rows than ``k`` there are fewer centroids; ties go to the smaller number; a centroid without vectors
stays where it is; without any vector the result is empty. Components of 2**20 or more raise an error, as sums of
squares could leave 64 bits. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

DIM = 64
SCALE = 64
LIMIT = 1 << 20
STAGES = (1, 4, 8, 16, 32, 64)
STEP_ROWS = 4096
SUM = pa.schema([("cluster", pa.int32()), ("pos", pa.int32()), ("s", pa.int64())])
SUM_DDL = "cluster int, pos int, s long"
OUT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _by_sequency() -> np.ndarray:
    """Rows of the transform by their number of sign changes."""
    signs = np.array([[bin(i & j).count("1") & 1 for j in range(DIM)] for i in range(DIM)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


SEQUENCY = _by_sequency()


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, coarse to fine; no division, so integers stay exact."""
    y, half = x, 1
    while half < DIM:
        pairs = y.reshape(len(x), DIM // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        y = np.stack((a + b, a - b), axis=2)
        half *= 2
    return y.reshape(len(x), DIM)[:, SEQUENCY]


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(64 * x) as integers: of 64 bits where sums of squares fit, else Python's own."""
    q = np.floor(v * SCALE)
    return q.astype(np.int64) if not q.size or np.abs(q).max() < 1 << 20 else q.astype(np.int64).astype(object)


def search(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For transformed rows: number of the nearest centroid, its squared distance, and how many coefficients were compared."""
    n, k = len(w), len(c)
    row, cent = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = np.zeros(n * k, w.dtype)
    bound, lo, work = None, 0, 0
    for hi in STAGES:
        gap = w[row, lo:hi] - c[cent, lo:hi]
        total = total + (gap * gap).sum(axis=1)
        work += len(row) * (hi - lo)
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(total, head)
        first = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[head, len(row)])))
        lead = first[np.r_[True, row[first][1:] != row[first][:-1]]]
        if hi == DIM:
            break
        rest = w[:, hi:] - c[cent[lead], hi:]
        whole = least + (rest * rest).sum(axis=1)
        work += n * (DIM - hi)
        bound = whole if bound is None else np.minimum(bound, whole)
        keep = total <= bound[row]
        row, cent, total, lo = row[keep], cent[keep], total[keep], hi
    return cent[lead], least // DIM, work


def assign(v: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integer vectors, cluster, distance), a bounded number of rows at once."""
    wide = max((abs(x) for c in centroids for x in c), default=0) >= 1 << 20
    for at in range(0, len(v), STEP_ROWS):
        q = quantised(v[at : at + STEP_ROWS])
        kind = object if wide or q.dtype == object else np.int64
        q = q.astype(kind)
        cluster, distance, _ = search(transform(q), transform(np.array(centroids, dtype=kind)))
        yield slice(at, at + len(q)), q, cluster, distance


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, DIM)


def _sums(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total = np.zeros((k, DIM + 1), np.int64)  # the last column counts
        for batch in batches:
            for _, q, cluster, _ in assign(vectors_of(batch), centroids):
                for c in np.unique(cluster):
                    mine = cluster == c
                    total[c, :DIM] += q[mine].sum(axis=0).astype(np.int64)
                    total[c, DIM] += mine.sum()
        c, pos = np.nonzero(np.broadcast_to(total[:, DIM:] > 0, total.shape))
        yield arrow_rows(SUM, cluster=c.astype(np.int32), pos=pos.astype(np.int32), s=total[c, pos])
    return run


def _assigned(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, cluster, distance in assign(vectors_of(batch), centroids):
                yield arrow_rows(OUT, vec_id=batch.column("vec_id")[rows], cluster=cluster.astype(np.int32), distance=distance.astype(np.int64))
    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors of 64 finite components as doubles."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == DIM) & fine)


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the least sha256 after ``seed`` and a colon, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return [[int(x) for x in quantised(np.array(r["v"], np.float64))] for r in rows]


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every usable vector, the final centroids)."""
    vectors = materialize(usable(df, id_col, vec_col), "vectors")
    beyond = vectors.filter(F.exists("v", lambda x: F.abs(x) >= LIMIT))
    if not beyond.isEmpty():
        raise ValueError(f"components of {LIMIT} or more: sums of squares could leave 64 bits")
    centroids = starts(vectors, k, seed)
    if not centroids:  # nothing to start from: no vectors, or none with an id
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(centroids), SUM_DDL).groupBy("cluster", "pos").agg(F.sum("s").alias("s")).collect()  # k x 65 rows
        got = {(r["cluster"], r["pos"]): r["s"] for r in sums}
        centroids = [[got[c, i] // got[c, DIM] for i in range(DIM)] if (c, DIM) in got else old for c, old in enumerate(centroids)]
    return materialize(vectors.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids


def centroid_report(spark: SparkSession, assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with the sums of distances by cluster and in all, and the sha256 of each row's centroid."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    whole = sum(s for s in sums.values() if s is not None)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, sums.get(c, 0), whole, digest(x)) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
