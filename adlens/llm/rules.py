"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over the same statistics.

Method: every whole text becomes counts (words, code points, symbols, repeated lines and words) and a row of shares
(``FEATURES``). A boosted sum of small regression trees with logistic loss is grown on quantile bins of the features.
Features named in ``FALLING`` are monotonic: a higher share never raises a score. Splits that would break this are not
taken, and the values below a split are bounded by the middle of its two sides, so that the whole tree keeps it. The
trees are flattened into numpy arrays of nodes, through which all rows of a batch walk together, level by level.

Training rows are a bounded, documented sample: about ``sample`` different rows with a label, by a cut on their hash
(all, if there are fewer). Counts cover whole texts.

Words and lines are compared as they are, never by a hash: words are numbered in order of first occurrence, and a
window of three words is a key of three such numbers.

Defined cases: null, empty and blank texts have zero counts and fail the base rules; a very long text is read in
parts, its numbers take some bytes a word; rows whose label is null are no training rows, and of several labels of
one id the least counts; without training rows of both classes there are no trees and the verdict keeps every document that passes the
base rules; rows without an id are scored like any other but never train; repeated rows and other columns don't
matter; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_rows, buffers, hash_sample, materialize, text_parts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_word_share", "upper_share", "digit_share", "exclaim_share",
            "mark_share", "wide_share", "log_line_length", "distinct_share")
FALLING = ("symbol_share", "dup_line_share", "repeat_word_share")
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:'\"()-?"
PART_BYTES = 1 << 20
STATS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("x", pa.binary())])
STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", x binary"


def word_numbers(body: memoryview) -> tuple[np.ndarray, int]:
    """Each word's number in order of first occurrence, and how many differ."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = [np.fromiter(map(number.__getitem__, part.split()), np.int32) for part in text_parts(body, PART_BYTES)]
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), len(number)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside windows of three words that occur twice or more, first occurrences included."""
    if len(ids) < 3:
        return 0
    wide = ids.astype(np.int64)
    pair = wide[:-1] * distinct + wide[1:]
    if distinct >= 1 << 20:  # keep keys of three words within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + wide[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(ids) + 2, bool)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for i in range(3):
        hit[i : i + len(key)] |= twice
    return int(hit.sum())


def lines_of(body: memoryview) -> tuple[int, int]:
    r"""(lines with a word, those equal to an earlier line); lines end at \n only."""
    seen, n = set(), 0
    for line in io.BytesIO(body):
        line = line[:-1] if line.endswith(b"\n") else line
        if line and not line.isspace():
            n += 1
            seen.add(line)
    return n, n - len(seen)


def _classes() -> np.ndarray:
    """Byte -> columns: a code point's first byte, white space, symbol, upper, digit, exclamation, other mark, wide."""
    t = np.zeros((256, 8), np.int64)
    b = np.arange(256)
    t[:, 0] = (b & 0xC0) != 0x80
    t[list(SPACES), 1] = 1
    t[list(SYMBOLS), 2] = 1
    t[65:91, 3] = 1
    t[48:58, 4] = 1
    t[33, 5] = 1
    t[list(MARKS), 6] = 1
    t[192:, 7] = 1
    return t


CLASSES = _classes()


def measure(body: memoryview) -> tuple[list[int], np.ndarray]:
    """(counts, features) of one whole text."""
    raw = np.frombuffer(body, np.uint8)
    points, spaces, symbols, upper, digits, exclaim, marks, wide = (np.bincount(raw, minlength=256) @ CLASSES).tolist()
    ids, distinct = word_numbers(body)
    n, chars = len(ids), points - spaces
    lines, dup = lines_of(body)
    repeat = repeated_words(ids, distinct)
    of_chars, of_words = max(chars, 1), max(n, 1)
    x = np.array([np.log1p(n), chars / of_words, symbols / of_chars, dup / max(lines, 1), repeat / of_words, upper / of_chars, digits / of_chars,
                  exclaim / of_chars, marks / of_chars, wide / of_chars, np.log1p(chars / max(lines, 1)), distinct / of_words], np.float32)
    return [n, chars, symbols, dup, repeat], x


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("body"))
        view, at = memoryview(raw), offsets.tolist()
        got = [measure(view[a:b]) for a, b in itertools.pairwise(at)]
        counts = zip(*[c for c, _ in got], strict=True) if got else [[]] * len(COUNTS)
        yield arrow_rows(STATS, doc_id=batch.column("doc_id"), x=[x.tobytes() for _, x in got], **dict(zip(COUNTS, counts, strict=True)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, x) of every row; x: the features as packed floats."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return own.mapInArrow(_stats, STATS_DDL)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Trees:
    """Boosted trees as arrays of nodes. A leaf is its own child; a row goes right if its feature exceeds the threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def split(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int, direction: np.ndarray, l2: float, least: float,
          low: float, high: float) -> tuple[int, int, float, float] | None:
    """Best (feature, last bin of the left side, left value, right value) of the rows ``at``, or None."""
    f = bins.shape[1]
    key = (bins[at] + np.arange(f) * n_bins).ravel()
    gs = np.bincount(key, np.repeat(g[at], f), f * n_bins).reshape(f, n_bins).cumsum(axis=1)
    hs = np.bincount(key, np.repeat(h[at], f), f * n_bins).reshape(f, n_bins).cumsum(axis=1)
    g_all, h_all = gs[:, -1:], hs[:, -1:]
    value = lambda a, b: np.clip(-a / (b + l2), low, high)
    gain_of = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
    left, right = value(gs, hs), value(g_all - gs, h_all - hs)
    gain = gain_of(gs, hs, left) + gain_of(g_all - gs, h_all - hs, right) - gain_of(g_all, h_all, value(g_all, h_all))
    allowed = (hs >= least) & (h_all - hs >= least) & ((right - left) * direction[:, None] >= 0)
    gain = np.where(allowed, gain, 0.0)
    best = int(gain.argmax())
    i, b = divmod(best, n_bins)
    return (i, b, float(left[i, b]), float(right[i, b])) if gain[i, b] > 1e-9 else None


def train(x: np.ndarray, y: np.ndarray, falling: tuple[str, ...] = FALLING, rounds: int = 40, depth: int = 3, rate: float = 0.2, n_bins: int = 32,
          l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for the log odds of label 1. ``least``: smallest sum of second derivatives on a side of a split."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(value)
        feature.append(0)
        threshold.append(0.0)
        left.append(i)
        right.append(i)
        value.append(v * rate)
        return i

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
        bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        direction = np.array([-1.0 if name in falling else 0.0 for name in FEATURES])
        raw = np.full(len(y), base)
        for _ in range(rounds):
            p = sigmoid(raw)
            g, h = p - y, p * (1 - p)
            roots.append(node(-g.sum() / (h.sum() + l2)))
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                got = split(bins, rows, g, h, n_bins, direction, l2, least, low, high) if level < depth else None
                if got is None or got[1] >= len(edges[got[0]]):
                    raw[rows] += value[at]
                    continue
                f, b, vl, vr = got
                feature[at], threshold[at] = f, float(edges[f][b])
                left[at], right[at] = node(vl), node(vr)
                middle = (vl + vr) / 2
                (ll, lh), (rl, rh) = ((low, high), (low, high)) if not direction[f] else ((middle, high), (low, middle))
                goes = bins[rows, f] > b
                todo += [(left[at], rows[~goes], level + 1, ll, lh), (right[at], rows[goes], level + 1, rl, rh)]
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, np.float32), np.array(left, np.int64),
                 np.array(right, np.int64), np.array(value), base if roots else 0.0, depth)


def fit(stats: DataFrame, labels: DataFrame, train_rows: Column, label_id: str = "doc_id", label_col: str = "quality", sample: int = 20_000) -> Trees:
    """Learns from about ``sample`` labelled rows of ``stats`` at most. ``train_rows``: a test of the column doc_id."""
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = materialize(stats.select("doc_id", "x").join(marks, "doc_id").filter(train_rows).select("doc_id", "x", "y"), "labelled")
    # equal rows are one; in one order, so that sums don't depend on partitions
    got = hash_sample(rows, F.xxhash64("doc_id", "x"), sample).select("x", "y", "o").distinct().orderBy("o", "y").toArrow()
    x = buffers(got.column("x"))[0].view(np.float32).reshape(-1, len(FEATURES))
    return train(x, (got.column("y").to_numpy() > 0.5).astype(np.float64))


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                  label_col: str = "quality", least_words: int = 50, repeat_percent: int = 50, cut: float = 0.3, sample: int = 20_000) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) of every row; kept: the base rules hold and the score reaches ``cut``."""
    stats = materialize(statistics(docs, id_col, text_col), "rule-statistics")
    held = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, train_rows, label_id, label_col, sample))  # some hundred nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = buffers(batch.column("x"))[0].view(np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *COUNTS)], pa.array(held.value.score(x), pa.float64())], names=["doc_id", *COUNTS, "score"])

    scored = stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut)).select("doc_id", *COUNTS, "base_failed", "score", "kept")
