"""Best-fit packing: documents into as few sequences of a fixed length as can be, by non-negative least squares.

Method: pattern packing. Lengths fall into ``units`` bins; patterns of few documents (bin numbers that add up to
the whole length) are enumerated, and non-negative least squares fits how often to repeat each pattern so that the
documents used match the length histogram. The repeats are rounded down and carried out; a pattern's last place and
any room left are filled with the longest lengths that fit. What remains is packed longest first, each sequence
filled with the longest length that fits.

All this works on the histogram of lengths, which is as small as a sequence is long, however many documents there
are: every step packs a run of equal sequences and uses up a length or a pattern. Documents of one length are
interchangeable, so a plan is a table of (length, ranks, sequences, offset); each document finds its row by its
rank among those of its length. Ranks come from counts by (task, length), so no length is gathered in one task.

Only documents longer than a sequence are cut; all their pieces but the last fill a sequence.

Defined cases: null and empty texts hold the end id only; repeated rows and ids are documents of their own (rows of
a repeated id come out once for each row); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

LENGTH = 4096
END_ID = 1
UNITS = 32
MOST = 8  # documents of a pattern


def patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """All falling sequences of 1 to ``most`` bin numbers that add up to ``units``."""
    out: list[tuple[int, ...]] = []

    def add(left: int, top: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(have)) < left:
                    break
                add(left - x, x, (*have, x))

    add(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares of a @ x - b with x >= 0, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        pull = atb - ata @ x
        pull[free] = -np.inf
        j = int(pull.argmax())
        if pull[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)).min()
            x[at] += step * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            drop = at[x[at] <= 0]
            free[drop if len(drop) else at[bad]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(hist: np.ndarray, units: int = UNITS, most: int = MOST) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that use up ``hist`` (documents by length, 0..whole)."""
    left, whole = hist.astype(np.int64).copy(), len(hist) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    width = -(-whole // units)

    def longest(room: int, used: dict[int, int], low: int = 1) -> int:
        """The longest length up to ``room`` that is left after ``used``, 0 if none."""
        while room >= low:
            at = np.flatnonzero(left[low : room + 1])
            if not len(at):
                return 0
            x = low + int(at[-1])
            if left[x] > used.get(x, 0):
                return x
            room = x - 1
        return 0

    def carry_out(bins: tuple[int, ...], times: int) -> None:
        while times > 0:
            used: dict[int, int] = {}
            made: list[int] = []
            room = whole
            for i, b in enumerate(bins):
                # the last place takes the longest that still fits
                x = longest(min(room, b * width if i + 1 < len(bins) else room), used, (b - 1) * width + 1)
                if not x:
                    break
                made.append(x)
                used[x] = used.get(x, 0) + 1
                room -= x
            if bins and len(made) < len(bins):
                return
            while room and (x := longest(room, used)):
                made.append(x)
                used[x] = used.get(x, 0) + 1
                room -= x
            if not made:
                return
            n = min(times, *(int(left[x]) // k for x, k in used.items()))
            for x, k in used.items():
                left[x] -= n * k
            out.append((tuple(made), n))
            times -= n

    if left[whole]:
        out.append(((whole,), int(left[whole])))
        left[whole] = 0
    if left.sum():
        shapes = patterns(units, most)
        bins = np.zeros(units + 1)
        np.add.at(bins, -(-np.arange(whole + 1) // width), left)
        a = np.zeros((units, len(shapes)))
        for j, shape in enumerate(shapes):
            for b in shape:
                a[b - 1, j] += 1
        # a long document left over costs more than a short one, which fills gaps
        cost = np.sqrt(np.arange(1, units + 1) / units)
        repeats = np.floor(nnls(a * cost[:, None], bins[1:] * cost) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: shapes[j], reverse=True):
            carry_out(shapes[j], int(repeats[j]))
    while left.sum():
        carry_out((), int(left.sum()))  # longest first: the first place takes the longest length left
    return out


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset): the plan as seen from the documents of a length."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for made, n in packed:
        at = 0
        for x in made:
            rows.setdefault(x, []).append((rank.get(x, 0), sequence, at))
            rank[x] = rank.get(x, 0) + n
            at += x
        sequence += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary"


def _pieces(tokenizer: str, length: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder

        encode = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + end
                for i, at in enumerate(range(0, len(ids), 4 * length)):
                    x = ids[at : at + 4 * length]
                    n = len(x) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(x), part, int(seen[n]), x if with_ids else None))
                    seen[n] += 1
                    size += 64 + len(x) * with_ids
                if size > 1 << 23:
                    yield arrow_rows(PIECE, **dict(zip(PIECE.names, zip(*rows, strict=True), strict=True)))
                    rows, size = [], 0
            if rows:
                yield arrow_rows(PIECE, **dict(zip(PIECE.names, zip(*rows, strict=True), strict=True)))
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
         with_ids: bool = True, units: int = UNITS, most: int = MOST) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and (``with_ids``) its ids as bytes."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(own.mapInArrow(_pieces(tokenizer, length, end_id, with_ids), PIECE_DDL), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    hist = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # ``length`` rows at most
        hist[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(slots(plan(hist, units, most)))  # bounded by lengths and patterns
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))

    out = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(at):
                    rows = table[int(size[at[0]])]
                    i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                    sequence[at], offset[at] = rows[i, 1] + rank[at] - rows[i, 0], rows[i, 2]
            cols = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset), batch.column("ids")],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", *out.names, "ids"])

    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
