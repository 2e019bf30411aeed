"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Method: vectors become binary codes by a learned rotation (principal directions, or a random orthonormal lift where
the code has more bits than the vector, then iterative quantisation: signs and rotation are fitted in turn). A
code is split into substrings and each substring is indexed. By the pigeonhole principle a code within ``radius``
bits has a substring within its share of the radius, so probing all substring values within those shares retrieves
every code within the radius; codes are then checked in full, and the rest is ranked by the original floats.

Rotation and radius are fitted on a bounded sample (about ``sample`` rows, by a cut on their hash): the radius holds ``recall`` of
the sampled rows' nearest pairs, as many of each row as stand for k among all rows. Every row is indexed. Where a block
holds fewer than k codes within the radius, the radius of that query grows there until it has k or the block ends.

A substring has 16 bits: where the radius leaves each substring a share of few bits, the values within that share are
looked up one by one; a larger share is compared with the values that occur in the block.

Rows are packed into blocks of a bounded size, and query blocks meet row blocks one pair at a time; a block's index is
built once for all query blocks it meets in a task. Each pair yields the k best of each query, merged by rank.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids
and vectors of another length than the most common one; rows that repeat an id are one (the least vector); ties
go to the smaller id; with fewer than k other rows all are returned; no vectors or no queries: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, hash_sample, materialize, ranges

BITS = 128
SUB = 16  # bits of a substring
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """(dimensions x bits): signs of ``x`` times this are the codes."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if bits <= d:
        _, _, v = np.linalg.svd(x, full_matrices=False)
        p = v[:bits].T if len(v) >= bits else np.linalg.qr(rng.normal(size=(d, bits)))[0]
    else:
        p = np.linalg.qr(rng.normal(size=(bits, d)))[0].T
    y = x @ p
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ vt).T
    return p @ r


def encode(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes; byte j is substring j."""
    return np.packbits(x @ rotation >= 0, axis=1)


def learn_radius(x: np.ndarray, codes: np.ndarray, k: int, n: int, recall: float) -> int:
    """Distance that holds ``recall`` of the nearest pairs of the sample, as many of each row as stand for k of n."""
    q = min(len(x), 400)
    if len(x) < 3:
        return codes.shape[1] * 8
    sims = x[:q] @ x.T
    sims[np.arange(q), np.arange(q)] = -np.inf
    far = np.bitwise_count(codes[:q, None, :] ^ codes[None, :, :]).sum(axis=2, dtype=np.int32)
    near = max(1, min(len(x) - 1, round(k * len(x) / max(n, 1))))  # as far as the k nearest of n, or farther
    at = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    return int(np.ceil(np.quantile(np.take_along_axis(far, at, axis=1), recall)))


_WEIGHT = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16))
#: All differences of a substring of at most so many bits.
_BALLS = [np.flatnonzero(_WEIGHT <= r).astype(np.uint16) for r in range(4)]


class CodeIndex:
    """Codes of one block and, for each substring, its values in order and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.parts = np.ascontiguousarray(codes).view(np.uint16)
        self.columns = []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            values, start = np.unique(part[order], return_index=True)
            self.columns.append((values, order, start, np.diff(np.r_[start, len(order)])))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a substring within its share of the radius."""
        own, m = code.view(np.uint16), len(self.columns)
        share, more = divmod(radius + 1, m)  # shares add up to radius + 1 - m, so one of them must hold
        found = np.zeros(len(self.words), bool)
        for j, (values, order, start, count) in enumerate(self.columns):
            reach = share - 1 + (j < more)
            if reach < 0:
                continue
            if reach < len(_BALLS) and len(_BALLS[reach]) < len(values):
                wanted = _BALLS[reach] ^ own[j]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                at = at[values[at] == wanted]
            else:
                at = np.flatnonzero(_WEIGHT[values ^ own[j]] <= reach)
            found[order[ranges(start[at], count[at])]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius: union of the probes, then the check in full."""
        rows = self.probed(code, radius)
        far = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1)
        return rows[far <= radius]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, radius: int, index: CodeIndex | None = None):
    """The k nearest found in one block for each query: arrays (query_id, vec_id, score)."""
    index, codes = index or CodeIndex(encode(x, rotation)), encode(q, rotation)
    bits = rotation.shape[1]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        r = radius
        while True:
            rows = index.within(codes[i], r)
            rows = rows[ids[rows] != q_ids[i]]
            if len(rows) >= k or r >= bits:
                break
            r = min(bits, r + max(4, bits // 16))
        score = x[rows] @ q[i]
        if len(rows) > k:
            limit = np.partition(score, len(score) - k)[len(score) - k]
            close = score >= limit - 1e-9
            rows = rows[close]
        # rank by one fixed order of summation, so that equal vectors have equal scores
        score = (x[rows] * q[i]).sum(axis=1)
        best = np.lexsort((ids[rows], -score))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_v.append(ids[rows[best]])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of the partition: ids and vectors as bytes. Rows arrive sorted by block."""
    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        ids = np.concatenate([b.column("vec_id").to_numpy().astype(np.int64) for b in held])
        vectors = np.concatenate([b.column("v").flatten().to_numpy().astype(np.float64) for b in held])
        return arrow_rows(schema, block=[held[0].column("block")[0].as_py()], ids=[ids.tobytes()], vectors=[vectors.tobytes()])

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(block)], strict=False):
            if held and held[0].column("block")[0].as_py() != block[lo]:
                yield packed()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield packed()


def blocks(vectors: DataFrame, n: int, name: str) -> DataFrame:
    """Rows dealt by their id into ``n`` blocks, each one packed row."""
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), "vec_id", "v").repartition(n, "block").sortWithinPartitions("block", "vec_id")
    return materialize(dealt.mapInArrow(_pack, "block int, ids binary, vectors binary"), name)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): usable vectors as doubles, one for each id."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(ok)
    one = materialize(own.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    size = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.filter(F.size("v") == (size["n"] if size else 0))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS,
            sample: int = 4000, recall: float = 0.97, block_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` (a test of ``vec_id``) holds for."""
    spark = df.sparkSession
    base = clean_vectors(df, id_col, vec_col)
    queries = base.filter(is_query)
    n, n_q = base.count(), queries.count()
    fit = hash_sample(base, F.xxhash64("vec_id"), sample).orderBy("o", "vec_id").select("v").toArrow().column("v").combine_chunks()
    if not len(fit) or not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = fit.flatten().to_numpy().reshape(len(fit), -1)
    rotation = learn_rotation(x, bits)
    radius = learn_radius(x, encode(x, rotation), k, n, recall)
    held = spark.sparkContext.broadcast(rotation)  # dimensions x bits floats

    n_blocks = max(-(-n // block_rows), 4 * spark.sparkContext.defaultParallelism)
    rows = blocks(base, n_blocks, "rows")
    asked = blocks(queries, max(1, -(-n_q // block_queries)), "queries")
    last, parts = rows.agg(F.max("block")).first()[0], 2 * n_blocks
    each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    # both sides are dealt by the row block, so that a block stays in one task with all queries
    pairs = rows.repartition(parts, "block").join(each.repartition(parts, "block").hint("merge"), "block")
    dim = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot, index, of = held.value, None, None
        for batch in batches:
            for i in range(len(batch)):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                x = get("vectors", np.float64).reshape(-1, dim)
                if batch.column("block")[i].as_py() != of:
                    of, index = batch.column("block")[i].as_py(), CodeIndex(encode(x, rot))
                q, v, s = search_block(get("q_ids", np.int64), get("q", np.float64).reshape(-1, dim), get("ids", np.int64), x, rot, k, radius, index)
                yield arrow_rows(OUT, query_id=q, vec_id=v, score=s)

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
