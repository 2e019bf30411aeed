"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Method: each whole text becomes a vector of statistics (``STATS``). Random Fourier features approximate a Gaussian
kernel over the standardised statistics. Each task sums the normal equations of its labelled rows, the sums are
added up, and one ridge system of fixed size is solved. Labelled rows that the ridge hasn't seen calibrate its
output: positives are counted in bins of the raw score, and pooling adjacent violators makes the rate monotone.

Defined cases: null, empty and blank texts have all-zero statistics and get a score like any other; a text of over a step
(1 MB) is read in parts, with the same statistics; rows whose
label is null are no training rows, and of several labels of one id the least counts; without any label the score
is 0.5, with one class only its rate; repeated rows and other columns don't matter; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import STEP_BYTES, arrow_rows, buffers, materialize, steps, text_parts

STATS = ("log_bytes", "log_words", "word_len", "word_len_sd", "upper", "lower", "digit", "space", "stop", "mark", "symbol", "wide",
         "newline", "distinct_words", "same_next", "distinct_lines", "line_len", "short_words", "long_words", "marked_words")
FEATURES = 192
BINS = 2048


def _classes() -> np.ndarray:
    """Byte -> row of indicator columns: upper, lower, digit, space, full stop, other punctuation, symbol, wide, newline."""
    t = np.zeros((256, 9), np.float32)
    for b in range(256):
        c = chr(b)
        col = 7 if b >= 128 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c in " \t\n\r\x0b\x0c" else 4 if c == "." else 5 if c in ",;:'\"()-?" else 6
        t[b, col] = 1
    t[10, 8] = 1
    return t


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    both = R.mix(key + R.mix(doc.astype(R.U) + R.U(1)))
    order = np.argsort(both)
    s = both[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    return np.bincount(doc[order[new]], minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ``STATS`` for texts that lie end to end."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATS)), np.float32)
    table, space = _classes(), R.white_space()
    line_end = np.zeros(256, bool)
    line_end[[10, 13]] = True
    for lo, hi in steps(offsets):
        part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        m, size = hi - lo, np.diff(off).astype(np.float64)
        if not len(part):
            continue
        if m == 1 and len(part) > STEP_BYTES:
            out[lo] = long_statistics(memoryview(part))
            continue
        doc_of_byte = np.repeat(np.arange(m), np.diff(off))
        share = np.bincount(doc_of_byte * 256 + part, minlength=m * 256).reshape(m, 256) @ table
        # a text's end closes its last word and line
        values = R.Hasher(R.byte_values(0)[part], 0)

        def cut(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            inner = np.unique(off[1:-1])
            i = np.searchsorted(at, inner) - 1
            inner = inner[(i >= 0) & (to[np.maximum(i, 0)] > inner)] if len(at) else inner[:0]
            at, to = np.union1d(at, inner), np.union1d(to, inner)
            return at, to, np.searchsorted(off, at, side="right") - 1

        at, to, doc = cut(*R.word_bounds(part, space))
        w_n = np.bincount(doc, minlength=m).astype(np.float64)
        w_len = (to - at).astype(np.float64)
        per_word = np.maximum(w_n, 1)
        key = values.spans(at, to)
        mean = np.bincount(doc, w_len, m) / per_word
        var = np.bincount(doc, w_len**2, m) / per_word - mean**2
        same = np.bincount(doc[1:], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]), m) / per_word if len(at) > 1 else np.zeros(m)
        last = part[to - 1]
        marked = np.bincount(doc, table[last, 6] > 0, m) / per_word
        l_at, l_to, l_doc = cut(*R.word_bounds(part, line_end))
        l_n = np.maximum(np.bincount(l_doc, minlength=m), 1)
        byte = np.maximum(size, 1)[:, None]
        out[lo:hi] = np.column_stack([
            np.log1p(size), np.log1p(w_n), mean, np.sqrt(np.maximum(var, 0)), share[:, :8] / byte, share[:, 8:] / byte,
            _distinct(key, doc, m) / per_word, same, _distinct(values.spans(l_at, l_to), l_doc, m) / l_n, np.log1p(size / l_n),
            np.bincount(doc, w_len <= 2, m) / per_word, np.bincount(doc, w_len >= 12, m) / per_word, marked])
        out[lo:hi][w_n == 0] = 0
    return out


def long_statistics(body: memoryview) -> np.ndarray:
    """The row of one long text, read in parts: beside a part, only eight bytes a word and a line are held."""
    table, of_byte = _classes(), np.zeros(256, np.int64)
    raw = np.frombuffer(body, np.uint8)
    for at in range(0, len(raw), STEP_BYTES):
        of_byte += np.bincount(raw[at : at + STEP_BYTES], minlength=256)
    share, size = of_byte @ table / len(raw), float(len(raw))
    keys, n, length, squares, short, long, marked = [], 0, 0, 0, 0, 0, 0
    for part in text_parts(body):
        words = part.split()
        lens = np.fromiter(map(len, words), np.int64, len(words))
        keys.append(np.fromiter(map(hash, words), np.int64, len(words)))
        n, length, squares = n + len(words), length + int(lens.sum()), squares + int((lens**2).sum())
        short, long = short + int((lens <= 2).sum()), long + int((lens >= 12).sum())
        marked += int((table[[w[-1] for w in words], 6] > 0).sum()) if words else 0
    if not n:
        return np.zeros(len(STATS), np.float32)
    key = np.concatenate(keys)
    lines = np.fromiter((hash(m.group()) for m in re.finditer(rb"[^\n\r]+", body)), np.int64)
    mean = length / n
    return np.array([
        np.log1p(size), np.log1p(n), mean, np.sqrt(max(squares / n - mean**2, 0)), *share,
        len(np.unique(key)) / n, (key[1:] == key[:-1]).sum() / n, len(np.unique(lines)) / len(lines), np.log1p(size / len(lines)),
        short / n, long / n, marked / n], np.float32)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("body"))
        rows = statistics(raw, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "x"])


def summed(df: DataFrame, width: int, fn: Callable[[pa.RecordBatch], np.ndarray], fan: int = 16) -> np.ndarray:
    """Sum of ``fn`` over all batches: one vector of ``width`` from each task, added up in ``fan`` tasks, then here."""
    schema = pa.schema([("s", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += fn(batch)
        yield arrow_rows(schema, s=[total.tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column("s"):
                total += np.frombuffer(x.as_buffer())
        yield arrow_rows(schema, s=[total.tobytes()])

    rows = df.mapInArrow(part, "s binary").repartition(fan).mapInArrow(add, "s binary").collect()  # fan rows of fixed size
    return sum((np.frombuffer(r["s"]) for r in rows), np.zeros(width))


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.column_stack([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.rates), 0, 1)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    raw, _ = buffers(batch.column("x"))
    return raw.view(np.float32).reshape(-1, len(STATS)).astype(np.float64)


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Monotone rates of bins in order, by pooling adjacent violators; every bin has rows."""
    out: list[list[float]] = []
    for a, b in zip(n.tolist(), ones.tolist(), strict=True):
        out.append([a, b, 1])
        while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
            a2, b2, c2 = out.pop()
            out[-1] = [out[-1][0] + a2, out[-1][1] + b2, out[-1][2] + c2]
    return np.repeat([b / a for a, b, _ in out], [c for _, _, c in out])


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = 1e-3, seed: int = 11) -> QualityModel:
    """``rows``: (x, y, part). Rows of part 0 calibrate, the others train."""
    d = len(STATS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch)
        return np.r_[len(x), x.sum(axis=0), (x**2).sum(axis=0)]

    train = rows.filter("part <> 0")
    total = summed(train, 1 + 2 * d, moments)
    n = max(total[0], 1)
    mean = total[1 : 1 + d] / n
    sd = np.sqrt(np.maximum(total[1 + d :] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(sd > 1e-9, sd, 1.0), rng.normal(0, np.sqrt(2 / d), (d, features)), rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    f = features + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.lift(matrix(batch)), batch.column("y").to_numpy().astype(np.float64)
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    if not total[0]:
        return model
    sums = summed(train, f * f + f, normal)
    model.weight = np.linalg.solve(sums[: f * f].reshape(f, f) / n + ridge * np.eye(f), sums[f * f :] / n)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(matrix(batch)) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, batch.column("y").to_numpy(), BINS)]

    bins = summed(rows.filter("part = 0"), 2 * BINS, binned)
    if not bins[:BINS].sum():  # no rows left to calibrate on
        bins = summed(train, 2 * BINS, binned)
    full = np.flatnonzero(bins[:BINS])
    model.knots, model.rates = (full + 0.5) / BINS * 2 - 0.5, isotonic(bins[full], bins[BINS + full])
    return model


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row as packed floats, as a written table."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return materialize(own.mapInArrow(_stats, "doc_id long, x binary"), "statistics")


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: Column, calibrate_rows: Column, id_col: str = "doc_id", text_col: str = "text",
                    label_id: str = "doc_id", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row. ``train_rows`` and ``calibrate_rows`` are tests of the column doc_id."""
    stats = statistics_of(docs, id_col, text_col)
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = materialize(stats.join(marks, "doc_id").filter(train_rows).select("x", "y", F.when(calibrate_rows, 0).otherwise(1).alias("part")), "labelled")
    held = docs.sparkSession.sparkContext.broadcast(fit(rows))  # a few hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
