"""Language ID: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

Method: every byte n-gram of 1 to 4 bytes of the lower-cased text is hashed to one of ``BUCKETS`` rows of an
embedding table; a document is the mean of its rows, and a linear softmax turns that into languages. Table and
softmax are trained together by stochastic gradient descent in numpy. Training rows are a bounded, documented
sample (about ``sample`` different rows, by a cut on their hash); their n-gram counts are taken from whole texts on
the executors. A part of the sample is held back: a temperature is fitted on it, so that scores are probabilities, and the rejection
threshold is the score that at most ``loss`` of its rightly predicted rows fall below, one half at most.

Prediction is linear in the n-grams, so table times softmax is one small table (buckets x languages) that goes to
every task. Only the text column goes to Python; a worker counts the buckets of each whole text and multiplies a few
rows of counts at once, so its memory depends neither on the number of languages nor on the length of a text.

Defined cases: null texts and texts without a letter get ``und`` with score 0; empty tables give empty results;
rows without a language or a text are no training rows; a training table without any language predicts ``und``;
ties between languages go to the first in order of name; repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, arrow_rows, buffers, hash_sample, steps

BUCKETS = 1 << 13
GRAMS = (1, 2, 3, 4)
DIM = 16
UND = "und"


def lowered(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes end to end, and offsets; null: empty. Blanks at both ends mark the first and last word."""
    return buffers(pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(text, "")), "", " ").cast(pa.binary()))


def text_steps(text: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about a megabyte, one text at least."""
    if len(text):
        _, off, _ = text.buffers()
        width = np.int64 if pa.types.is_large_string(text.type) else np.int32
        for lo, hi in steps(np.frombuffer(off, width)[text.offset : text.offset + len(text) + 1].astype(np.int64)):
            yield text[lo:hi]


def gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes from each position."""
    size = max(0, len(raw) - n + 1)
    key = np.full(size, n, np.uint32)
    for i in range(n):
        key = (key << np.uint32(8)) ^ raw[i : i + size] if n <= 3 else key * np.uint32(257) + raw[i : i + size]
    key = key * np.uint32(2654435761)
    key ^= key >> np.uint32(15)
    return (key * np.uint32(2246822519)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counts(raw: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in one text of any length."""
    out = np.zeros(BUCKETS, np.float32)
    for n in GRAMS:
        for lo in range(0, max(1, len(raw) - n + 1), STEP_BYTES):
            out += np.bincount(gram_buckets(raw[lo : lo + STEP_BYTES + n - 1], n), minlength=BUCKETS)
    return out


def counts_of(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """``counts`` of each of the texts that lie end to end."""
    if len(raw) > 2 * STEP_BYTES:
        yield from (counts(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        return
    keys = np.full((len(GRAMS), len(raw)), BUCKETS, np.uint16)  # one bucket more: n-grams that a text's end cuts off
    for row, n in zip(keys, GRAMS, strict=True):
        found = gram_buckets(raw, n)
        row[: len(found)] = found
        for i in range(1, n):
            row[np.maximum(offsets[1:] - i, 0)] = BUCKETS
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.bincount(keys[:, a:b].ravel(), minlength=BUCKETS + 1)[:BUCKETS].astype(np.float32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("share", pa.binary())])
    for batch in batches:
        at, share = [], []
        for part in text_steps(batch.column("text")):
            for c in counts_of(*lowered(part)):
                hit = np.flatnonzero(c)
                at.append(hit.astype(np.uint16).tobytes())
                share.append((c[hit] / c.sum()).astype(np.float32).tobytes())
        yield arrow_rows(schema, lang=batch.column("lang"), at=at, share=share)


class Rows:
    """Training rows as the buckets they have and their shares; only the rows of one step are spread out."""

    def __init__(self, at: list[bytes], share: list[bytes]):
        self.at, self.share = at, share

    def __len__(self) -> int:
        return len(self.at)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for to, i in zip(out, rows.tolist(), strict=True):
            to[np.frombuffer(self.at[i], np.uint16)] = np.frombuffer(self.share[i], np.float32)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    @staticmethod
    def train(x: Rows, y: np.ndarray, langs: list[str], epochs: int = 12, rate: float = 0.5, loss: float = 0.001, seed: int = 7) -> LanguageModel:
        """``x``: n-gram shares; ``y``: language numbers. Every fifth row is held back for calibration."""
        rng = np.random.default_rng(seed)
        k = len(langs)
        emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 10 else np.zeros(len(y), bool)
        rows = np.flatnonzero(~held)
        scale = np.float32(64)  # mean vectors are short; the scale keeps steps of plain size
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            for lo in range(0, len(rows), 32):
                at = rows[lo : lo + 32] if epoch == 0 else rng.choice(rows, 32)
                part = x.dense(at)
                mean = (part @ emb) * scale
                wrong = softmax(mean @ w + b)
                wrong[np.arange(len(at)), y[at]] -= 1
                wrong /= len(at)
                back = wrong @ w.T
                w -= step * (mean.T @ wrong)
                b -= step * wrong.sum(axis=0)
                emb -= step * scale * (part.T @ back)
        flat, bias = (emb @ w) * scale, b
        cal = np.flatnonzero(held) if held.any() else rows
        logits = np.concatenate([x.dense(cal[lo : lo + 256]) @ flat for lo in range(0, len(cal), 256)]) + bias
        best = min((0.25 * 1.25**i for i in range(24)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(cal)), y[cal]] + 1e-12).sum())
        p = softmax(logits / best)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[cal]])
        threshold = min(0.5, float(right[int(loss * len(right))])) if len(right) else 0.5
        return LanguageModel(langs, flat.astype(np.float32), bias, float(best), threshold)

    def scores(self, raw: np.ndarray, offsets: np.ndarray, group: int = 64) -> np.ndarray:
        """Probabilities (rows x languages) of texts that lie end to end; ``group`` rows of counts are held at once."""
        out, rows, lo = np.zeros((len(offsets) - 1, len(self.langs))), [], 0
        for i, c in enumerate(counts_of(raw, offsets)):
            rows.append(c)
            if len(rows) == group or i == len(out) - 1:
                c = np.stack(rows)
                out[lo : i + 1] = (c @ self.table) / np.maximum(c.sum(axis=1), 1)[:, None]
                rows, lo = [], i + 1
        return softmax((out + self.bias) / self.temperature)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 4000) -> LanguageModel:
    """Learns from about ``sample`` of the rows at most; texts are counted whole. Equal rows are one."""
    usable = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    own = hash_sample(usable, F.xxhash64("id", "text"), sample).groupBy("o").agg(F.min(F.struct("lang", "text")).alias("r")).select("o", "r.*")
    got = own.orderBy("o").select("lang", "text").mapInArrow(_count, "lang string, at binary, share binary").toArrow()
    lang = got.column("lang").to_pylist()
    langs = sorted(set(lang))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.5)
    x = Rows(got.column("at").to_pylist(), got.column("share").to_pylist())
    return LanguageModel.train(x, np.array([langs.index(v) for v in lang]), langs)


def judged(docs: DataFrame, model: LanguageModel, text_col: str) -> Column:
    """struct(lang, score, accepted) of the text column."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats
    schema = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang string, score double, accepted boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in batches:
            out = []
            for text in text_steps(batch):
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if m.langs:
                    p = m.scores(*lowered(text))
                    best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
                else:
                    best, score, letters = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text), bool)
                names = [m.langs[i] if ok else UND for i, ok in zip(best, letters, strict=True)]
                out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(letters & (score >= m.threshold))], fields=list(schema)))
            yield pa.concat_arrays(out) if out else pa.array([], schema)

    return judge(F.col(text_col))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted, ...): calibrated probability of the best language.

    ``accepted``: the text has a letter and the score reaches the model's threshold. ``more``: further columns by name.
    """
    extra = more or {}
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), judged(docs, model, text_col).alias("p"), *[c.alias(n) for n, c in extra.items()])
    return own.select("doc_id", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted", *[F.col(f"`{n}`") for n in extra])


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model accepts, all columns as they were."""
    return docs.filter(judged(docs, model, text_col)["accepted"])
