"""Hard-negative mining: for each anchor and each of its best same-label rows, the best rows of other labels in a score band.

Method: Kronecker-packed products. Components become integers; a bias makes them non-negative. The i-th components of
all candidates of a block are put side by side into one wide integer, each in a field of its own that is wide enough
for a whole inner product. One multiplication of that integer by an anchor's i-th component then multiplies all
candidates at once; after as many multiplications as there are components the fields of the sum are read out, the
bias is taken back, and the scores are exact.

Rows are packed into blocks of a bounded size. Anchors meet the blocks in two passes: the first finds the positives,
the second, which knows each positive's score, the negatives. Each (block, anchor) pair yields a fixed number of
rows, which are merged by rank. The work is anchors x rows, as every row's exact score decides; nothing is gathered
by label, so a label with most of the rows is split like any other.

Defined cases: rows with a null id or label, a null or empty vector, or a null or non-finite component take no part,
nor do vectors of another length than the most common one (the shortest of these, if tied). Rows that repeat an id
are one row: the least label, then the least vector. An anchor without a positive, or a positive without a
negative in the band, gives no rows; no anchors or no rows: an empty result. If scores could need over 56 bits, that is
an error. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

PACK = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary()),
                  ("n_pos", pa.binary()), ("pos_ids", pa.binary()), ("pos_scores", pa.binary())])
PACK_DDL = "block int, ids binary, labels binary, q binary, n_pos binary, pos_ids binary, pos_scores binary"
POS = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
POS_DDL = "anchor_id long, positive_id long, positive_score long"
NEG = pa.schema([*POS, ("negative_id", pa.int64()), ("negative_score", pa.int64())])
NEG_DDL = POS_DDL + ", negative_id long, negative_score long"


class Packed:
    """Integer candidates, component by component, in the fields of one wide integer each."""

    def __init__(self, q: np.ndarray, bias: int, field: int):
        """``q``: rows of integers of at least ``-bias``; ``field``: bytes of a field (4 or 8)."""
        self.n, self.bias, self.kind = len(q), bias, f"<u{field}"
        lifted = q.astype(np.int64) + bias
        self.sums = lifted.sum(axis=1)
        self.wide = [int.from_bytes(column.astype(self.kind).tobytes(), "little") for column in lifted.T]
        self.size = self.n * field

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of all candidates with one row of integers."""
        a = (anchor.astype(np.int64) + self.bias).tolist()
        total = 0
        for x, w in zip(a, self.wide, strict=True):
            total += x * w
        fields = np.frombuffer(total.to_bytes(self.size, "little"), self.kind).astype(np.int64)
        return fields - self.bias * (sum(a) + self.sums - len(a) * self.bias)


def field_bytes(low: int, high: int, dim: int) -> tuple[int, int]:
    """(bias, bytes of a field) for components from ``low`` to ``high``."""
    bias = max(0, -low)
    bits = (dim * (max(high, 0) + bias) ** 2).bit_length()
    if bits > 56:
        raise ValueError(f"inner products of components from {low} to {high} may need {bits} bits")
    return bias, 4 if bits <= 32 else 8


def usable(df: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, label, q): rows that take part, one for each id, components as floor(scale * x)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    one = own.select("vec_id", F.struct("label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("q")).alias("r"))
    return one.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """One row for the rows of one block."""
    col = lambda name: rows.column(name).combine_chunks()
    numbers = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
    extra = [b"", b"", b""]
    if "pos" in rows.column_names:
        pos = col("pos")
        flat = pos.flatten()
        extra = [np.diff(pos.offsets.to_numpy()).astype(np.int64).tobytes(), numbers(flat.field("positive_id")), numbers(flat.field("positive_score"))]
    return arrow_rows(PACK, block=[col("block")[0].as_py()], ids=[numbers(col("vec_id"))], labels=[numbers(col("label"))],
                      q=[numbers(col("q").flatten())], n_pos=extra[:1], pos_ids=extra[1:2], pos_scores=extra[2:])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of the partition, in order of id. Rows arrive sorted by block and id."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(block)], strict=False):
            if held and held[0].column("block")[0].as_py() != block[lo]:
                yield _packed(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _packed(pa.Table.from_batches(held))


def blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Packed blocks: rows dealt by their id into ``n`` blocks, each one row."""
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), *rows.columns).repartition(n, "block").sortWithinPartitions("block", "vec_id")
    return materialize(dealt.mapInArrow(_pack, PACK_DDL), name)


def meet(rows: DataFrame, anchors: DataFrame, work: Callable, ddl: str, parts: int) -> DataFrame:
    """``work`` on each (block of rows, block of anchors); both sides are dealt by the block of rows."""
    last = rows.agg(F.max("block").alias("m")).first()["m"]
    if last is None:
        last = -1
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block") if last >= 0 else F.lit(0).alias("block"),
                           *[F.col(c).alias(f"a_{c}") for c in PACK.names[1:]])
    pairs = rows.repartition(parts, "block").join(asked.repartition(parts, "block").hint("merge"), "block")
    return pairs.mapInArrow(work, ddl)


def _numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), np.int64)


def _each(batches: Iterator[pa.RecordBatch], dim: int, bias: int, field: int) -> Iterator[tuple]:
    """(ids, labels, packed rows, batch, row) of each pair; a block's rows are packed once while it stays the same."""
    held = None
    for batch in batches:
        for i in range(len(batch)):
            block = batch.column("block")[i].as_py()
            if held is None or held[0] != block:
                held = (block, _numbers(batch, "ids", i), _numbers(batch, "labels", i), Packed(_numbers(batch, "q", i).reshape(-1, dim), bias, field))
            yield *held[1:], batch, i


def best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` positions of ``at`` with the highest scores, ties in the order of ``at``."""
    if len(at) > k:
        limit = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= limit]
    return at[np.argsort(-score[at], kind="stable")][:k]


def _positives(dim: int, bias: int, field: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, packed, batch, i in _each(batches, dim, bias, field):
            anchors, marks, q = _numbers(batch, "a_ids", i), _numbers(batch, "a_labels", i), _numbers(batch, "a_q", i).reshape(-1, dim)
            out_a, out_p, out_s = [], [], []
            for anchor, mark, a in zip(anchors, marks, q, strict=True):
                at = np.flatnonzero((labels == mark) & (ids != anchor))
                if not len(at):
                    continue
                score = packed.scores(a)
                at = best(score, at, k)
                out_a.append(np.full(len(at), anchor))
                out_p.append(ids[at])
                out_s.append(score[at])
            if out_a:
                yield arrow_rows(POS, anchor_id=np.concatenate(out_a), positive_id=np.concatenate(out_p), positive_score=np.concatenate(out_s))
    return run


def _negatives(dim: int, bias: int, field: int, k: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, packed, batch, i in _each(batches, dim, bias, field):
            anchors, marks, q = _numbers(batch, "a_ids", i), _numbers(batch, "a_labels", i), _numbers(batch, "a_q", i).reshape(-1, dim)
            ends = np.cumsum(_numbers(batch, "a_n_pos", i))
            pos_ids, pos_scores = _numbers(batch, "a_pos_ids", i), _numbers(batch, "a_pos_scores", i)
            out: list[list[np.ndarray]] = [[] for _ in NEG]
            for j, (anchor, mark, a) in enumerate(zip(anchors, marks, q, strict=True)):
                score = packed.scores(a)
                at = np.flatnonzero(labels != mark)
                at = at[np.argsort(-score[at], kind="stable")]
                falling = -100 * score[at]
                for p in range(ends[j - 1] if j else 0, ends[j]):
                    # the band is one stretch of the sorted scores
                    start = np.searchsorted(falling, -high * pos_scores[p], side="left")
                    end = np.searchsorted(falling, -low * pos_scores[p], side="right")
                    found = at[start : min(end, start + k)]
                    for got, value in zip(out, (np.full(len(found), anchor), np.full(len(found), pos_ids[p]), np.full(len(found), pos_scores[p]), ids[found], score[found]), strict=True):
                        got.append(value)
            if out[0]:
                yield arrow_rows(NEG, **{f.name: np.concatenate(c) for f, c in zip(NEG, out, strict=True)})
    return run


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 8192, block_anchors: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: a test of the column vec_id. ``low`` and ``high``: the band in hundredths of the positive's score.
    """
    spark = df.sparkSession
    base = materialize(usable(df, label, id_col, vec_col, scale), "usable")
    sizes = base.groupBy(F.size("q").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high"))
    size = sizes.orderBy(F.desc("n"), "dim").first()
    if size is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim = size["dim"]
    bias, field = field_bytes(size["low"], size["high"], dim)
    base = base.filter(F.size("q") == dim)
    anchors = base.filter(is_anchor)
    n_blocks = max(-(-size["n"] // block_rows), 4 * spark.sparkContext.defaultParallelism)
    n_asked = max(1, -(-anchors.count() // block_anchors))
    rows = blocks(base, n_blocks, "rows")

    found = meet(rows, blocks(anchors, n_asked, "anchors"), _positives(dim, bias, field, positives), POS_DDL, 2 * n_blocks)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = materialize(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives).drop("r"), "positives")
    of_anchor = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pos"))  # a few each
    asked = blocks(anchors.join(of_anchor, "vec_id"), n_asked, "asked")

    found = meet(rows, asked, _negatives(dim, bias, field, negatives, low, high), NEG_DDL, 2 * n_blocks)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
