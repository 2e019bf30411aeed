"""Substring dedup: removes every word of a window of ``window`` words that starts at another place too.

Method: super-k-mer partitioning. Consecutive windows that share a minimiser (the word k-gram of least hash)
travel as one packed string to the minimiser's bucket, where sorting counts the windows exactly. Copies of a
packed string are counted before they travel, and a minimiser seen once never travels (see ``repeats``).

Defined cases: null, empty and blank texts have no words; a repeated row counts as another document; an empty
table gives an empty table; ids may be null or repeated; other columns are never read. Windows never cross
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, buffers
from .repeats import keyed, merge, repeated_spans

WINDOW = 35
KGRAM = 16


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each packed string, which of its windows occur at two places: windows of word numbers are sorted and counted."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in x.split(b" ")], np.int32) for x in strings]
    sizes = np.array([len(x) for x in ids], np.int64)
    all_ids = np.concatenate(ids)
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) - np.repeat(ends - counts - starts, counts)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(all_ids, window)[at])
    _, which, seen = np.unique(rows.view(np.dtype((np.void, rows.itemsize * window))).ravel(), return_inverse=True, return_counts=True)
    return np.split(seen[which] > 1, ends[:-1])


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(did, h, spans): the word spans to remove, for documents that have any."""
    return repeated_spans(docs, id_col, text_col, True, window, max(1, min(KGRAM, window - 1)), repeated_windows)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def kept_words(words: list[bytes], cuts: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for s, e in cuts:
        out += words[at:s]
        at = e
    return out + words[at:]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            out = []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                words = raw[offsets[row] : offsets[row + 1]].tobytes().split()
                cuts = merge(spans)
                kept = b" ".join(kept_words(words, cuts))
                out.append((len(words), sum(e - s for s, e in cuts), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield arrow_rows(OUT, doc_id=batch.column("doc_id"), **dict(zip(OUT.names[1:], cols, strict=True)))
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row for each document: words, removed words and the kept words joined by one space (null without ``with_text``)."""
    spans = repeated_words(docs, id_col, text_col, window)
    own = keyed(docs, id_col, text_col, docs[id_col].cast("long").alias("doc_id"))
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return own.join(spans, ["did", "h"], "left").select("doc_id", "body", "spans").mapInArrow(_cut(with_text), ddl)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words cut out of their texts, all other columns as they were.

    Texts that lose nothing stay as they are, white space included; of the others the kept words remain, joined by
    one space, which may be none.
    """
    names = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(names)}  # whatever the columns are called
    spans = repeated_words(docs, id_col, text_col, window)
    own = keyed(docs, id_col, text_col, *[docs[c].alias(inner[c]) for c in names if c != text_col])
    rest = [inner[c] for c in names if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            texts = []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                text = raw[offsets[row] : offsets[row + 1]].tobytes()
                texts.append((b" ".join(kept_words(text.split(), merge(spans))) if spans else text).decode())
            got = pa.array([t if ok else None for t, ok in zip(texts, batch.column("body").is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([got, *[batch.column(c) for c in rest]], names=["t", *rest])

    joined = own.join(spans, ["did", "h"], "left").select("body", "spans", *rest)
    ddl = ", ".join(["t string", *[f"{inner[c]} {t}" for c, t in docs.dtypes if c != text_col]])
    return joined.mapInArrow(cut, ddl).select(*[F.col("t" if c == text_col else inner[c]).alias(c) for c in names])
