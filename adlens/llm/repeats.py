"""Finds every window of consecutive symbols that occurs at two or more places of a corpus, exactly.

Both long-repeat operators share this plan; they differ in the symbol (byte or word) and in what compares
the strings of one bucket.

1. Each document is cut into runs of consecutive windows that share one minimiser. Only the run's minimiser,
   the digest of its string and its place are written, not its text. Digests are BLAKE2b, which nobody knows how to
   make collide: runs of one minimiser with equal digests are the same string.
2. Runs are counted by minimiser. A minimiser seen once has no repeated window (no two windows of one run are
   equal). If all runs of a minimiser are the same string, all its windows repeat.
3. The other minimisers are open: their runs are grouped by string, so that any number of copies is one row.
   A string seen twice repeats as a whole. One copy of each distinct string travels to its minimiser's bucket.
4. A bucket compares its strings exactly. A minimiser with more than ``hot_strings`` distinct strings is never
   gathered: its windows are spread and counted by a 128-bit digest of the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import STEP_BYTES, arrow_rows, buffers, materialize, steps, text_key, text_parts

RUN = pa.schema([("did", pa.int64()), ("h", pa.int32()), ("a", pa.int64()), ("s", pa.int64()), ("start", pa.int64()), ("n_win", pa.int32())])
PIECE = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("did", pa.int64()), ("h", pa.int32()), ("start", pa.int64()), ("n_win", pa.int32()), ("str", pa.binary()), ("w", pa.int64()), ("v", pa.int64())])
SPAN = pa.schema([("did", pa.int64()), ("h", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_DDL = "did long, h int, start long, end long"


class Symbols:
    """The symbols of documents that lie end to end: bytes, or words between white space.

    ``doc``: the first symbol of each document, and the number of all. Symbol i lies at ``at[i]``..``to[i]`` of ``text``,
    in which words are joined by one space.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, words: bool):
        self.words = words
        if not words:
            self.text, self.doc, self.hashes = memoryview(raw), offsets, R.byte_values(0)[raw]
            return
        view, joined, sizes, hashes, doc = memoryview(raw), [], [np.zeros(0, np.int64)], [np.zeros(0, R.U)], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = doc[-1]
            for part in text_parts(view[a:b]):
                found = part.split()
                if found:
                    joined.append(b" ".join(found))
                    sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                    hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), R.U, len(found)))
                    n += len(found)
            doc.append(n)
        self.text, self.doc, self.hashes = memoryview(b" ".join(joined)), np.array(doc, np.int64), np.concatenate(hashes)
        size = np.concatenate(sizes)
        self.at = np.cumsum(size + 1) - size - 1
        self.to = self.at + size

    def string(self, lo: int, hi: int) -> memoryview:
        """Symbols lo..hi-1; words joined by one space."""
        if not self.words:
            return self.text[lo:hi]
        return self.text[self.at[lo] : self.to[hi - 1]] if hi > lo else self.text[:0]

    def digests(self, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        """BLAKE2b of each string in ``size`` bytes, as one or two longs a row."""
        a, b = (start, end) if not self.words else (self.at[start], self.to[end - 1])
        text = self.text
        found = [blake2b(text[i:j], digest_size=size).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        return np.frombuffer(b"".join(found), "<i8").reshape(len(found), size // 8)


def parts(raw: np.ndarray, offsets: np.ndarray, words: bool) -> Iterator[tuple[int, int, Symbols]]:
    for lo, hi in steps(offsets):
        yield lo, hi, Symbols(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def scan(words: bool, window: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            did, h = batch.column("did").to_numpy(), batch.column("h").to_numpy()
            for lo, hi, sym in parts(raw, offsets, words):
                bounds = sym.doc
                # a very long document: segments that overlap by a window less one
                jumps = [(0, bounds[-1])] if hi - lo > 1 or bounds[-1] <= STEP_BYTES else [
                    (c, min(c + STEP_BYTES + window - 1, bounds[-1])) for c in range(0, max(1, bounds[-1] - window + 1), STEP_BYTES)]
                for c, e in jumps:
                    start, end = (bounds[:-1], bounds[1:]) if e - c == bounds[-1] else (np.array([0]), np.array([e - c]))
                    doc, first, n, a = R.minimiser_runs(sym.hashes[c:e], start, end, window, k)
                    if len(doc):
                        s = sym.digests(first + c, first + c + n + window - 1, 8)[:, 0]
                        yield arrow_rows(RUN, did=did[lo + doc], h=h[lo + doc], a=a.view(np.int64), s=s, start=first - start[doc] + c, n_win=n.astype(np.int32))
    return run


def fetch(words: bool, window: int) -> Callable:
    """Texts of the wanted runs: one packed string each, or for hot minimisers one digest row for each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            did, h, want = batch.column("did").to_pylist(), batch.column("h").to_pylist(), batch.column("want")
            out, size = [], 0
            for row, key in enumerate(zip(did, h, strict=True)):
                if key == last:  # a repeated row: one copy is enough to compare with
                    continue
                last = key
                sym = Symbols(raw[offsets[row] : offsets[row + 1]], offsets[row : row + 2] - offsets[row], words)
                for x in want[row].as_py():
                    if not x["hot"]:
                        text = sym.string(x["start"], x["start"] + x["n_win"] + window - 1).tobytes()
                        out.append((x["a"], x["n"], *key, x["start"], x["n_win"], text, 0, 0))
                        size += len(text)
                        continue
                    first = x["start"] + np.arange(x["n_win"])
                    found = sym.digests(first, first + window, 16).tolist()
                    out += [(x["a"], x["n"], *key, i, 1, None, w, v) for i, (w, v) in zip(first.tolist(), found, strict=True)]
                    size += 60 * x["n_win"]
                if size > STEP_BYTES * 4:
                    yield arrow_rows(PIECE, **dict(zip(PIECE.names, zip(*out, strict=True), strict=True)))
                    out, size = [], 0
            if out:
                yield arrow_rows(PIECE, **dict(zip(PIECE.names, zip(*out, strict=True), strict=True)))
    return run


def bucket(repeated: Callable, window: int, size: int) -> Callable:
    """Compares the strings of whole buckets, about ``size`` bytes at once. Rows arrive sorted by minimiser.

    ``repeated(strings, window)`` gives for each string a boolean array of its windows.
    """
    def spans(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        found = repeated(rows["str"], window)
        did, h, start, end = [], [], [], []
        for i, hit in enumerate(found):
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1)
            first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
            did += [rows["did"][i]] * len(first)
            h += [rows["h"][i]] * len(first)
            start += (rows["start"][i] + first).tolist()
            end += (rows["start"][i] + last + window).tolist()
        if did:
            yield arrow_rows(SPAN, did=did, h=h, start=start, end=end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("a", "did", "h", "start", "str")
        held: dict[str, list] = {x: [] for x in names}
        weight = 0
        for batch in batches:
            cols = {x: batch.column(x).to_pylist() for x in names}
            for i, a in enumerate(cols["a"]):
                if weight > size and a != held["a"][-1]:
                    yield from spans(held)
                    held, weight = {x: [] for x in names}, 0
                for x in names:
                    held[x].append(cols[x][i])
                weight += len(cols["str"][i])
        if weight:
            yield from spans(held)
    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(did, h, body, ...): did and h tell rows apart by their id and text together; equal rows share both."""
    return docs.select(F.xxhash64(id_col, text_col).alias("did"), text_key(F.col(text_col)).alias("h"), F.col(text_col).cast("binary").alias("body"), *more)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, words: bool, window: int, k: int, repeated: Callable,
                   hot_strings: int = 4000, bucket_bytes: int = 1 << 20) -> DataFrame:
    """One row (did, h, spans) for each document with a repeated window; spans of symbols, overlapping and unordered.

    did and h are those of ``keyed``. A repeated row counts as one more document, but its spans are listed once.
    """
    texts = keyed(docs, id_col, text_col).filter(F.col("body").isNotNull())
    runs = materialize(texts.mapInArrow(scan(words, window, k), "did long, h int, a long, s long, start long, n_win int"), "runs")
    seen = materialize(
        runs.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        .filter("c > 1").select("a", (F.col("lo") != F.col("hi")).alias("open")), "minimisers")
    again = materialize(runs.join(seen, "a"), "again")
    whole = again.filter(~F.col("open")).select("did", "h", "start", (F.col("start") + F.col("n_win") + F.lit(window - 1)).alias("end"))

    undecided = again.filter("open")
    kinds = materialize(
        undecided.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "h", "start", "n_win")).alias("one"))
        .select("a", "s", "n", "one.*"), "kinds")
    hot = materialize(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot_strings).select(F.col("a"), F.lit(True).alias("hot")), "hot")
    copies = undecided.join(kinds.filter("n > 1").select("a", "s"), ["a", "s"], "left_semi").select(
        "did", "h", "start", (F.col("start") + F.col("n_win") + F.lit(window - 1)).alias("end"))

    want = (kinds.join(hot, "a", "left").groupBy("did", "h")
            .agg(F.collect_list(F.struct("a", "n", "start", "n_win", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want")))
    ddl = "a long, n long, did long, h int, start long, n_win int, str binary, w long, v long"
    pieces = materialize(texts.join(want, ["did", "h"]).mapInArrow(fetch(words, window), ddl), "pieces")

    cold = pieces.filter("str is not null").select("a", "did", "h", "start", "str")
    found = (cold.repartition("a").sortWithinPartitions("a", "did", "h", "start")
             .mapInArrow(bucket(repeated, window, bucket_bytes), SPAN_DDL))
    windows = pieces.filter("str is null")
    twice = materialize(
        windows.groupBy("a", "w", "v").agg(F.min(F.struct("did", "h", "start")).alias("lo"), F.max(F.struct("did", "h", "start")).alias("hi"))
        .filter("lo != hi").select("a", "w", "v"), "twice")
    spread = windows.join(twice, ["a", "w", "v"], "left_semi").select("did", "h", "start", (F.col("start") + F.lit(window)).alias("end"))

    spans = whole.unionByName(copies).unionByName(found).unionByName(spread)
    return spans.groupBy("did", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out
