"""Suffix-array dedup: removes every byte of a string of ``min_bytes`` bytes that starts at another place too.

Method: threshold-bounded interval expansion on a Burrows-Wheeler transform. Within a bucket the suffixes are
ordered to the threshold's depth, the transform is taken, and intervals of rows with a common prefix are
extended backward by one byte, breadth first, so that common-prefix lengths come out by increasing value.
At the threshold the expansion stops: rows whose boundary is still unset share that many bytes.

Buckets are those of ``repeats``: equal strings have equal minimisers, so all places of a string meet in one.

Defined cases: null and empty texts have no bytes and are kept as they are; a repeated row counts as another
document (so its strings repeat); an empty table gives an empty table; ids may be null or repeated; other
columns are never read. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, buffers
from .repeats import keyed, merge, repeated_spans

MIN_BYTES = 200
KGRAM = 96


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (0: separator) in the order of their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    width = 7  # symbols of 9 bits in the first key
    key = np.zeros(n + width, np.uint64)
    wide = np.zeros(n + width, np.uint64)
    wide[:n] = text
    for i in range(width):
        key[:n] |= wide[i : i + n] << np.uint64(9 * (width - 1 - i))
    order = np.argsort(key[:n])
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + depth, np.int64)  # a suffix's rank is its group's first row; past the end: lowest
    rank[order] = head + 1
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = width
    while h < depth and len(tied):
        at = order[tied]
        group = rank[at]
        pair = group.astype(np.uint64) << np.uint64(32) | rank[at + h].astype(np.uint64)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[tied] = at
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        tied = tied[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def shared_rows(text: np.ndarray, order: np.ndarray, min_len: int) -> np.ndarray:
    """For each row of ``order``: does it share its first ``min_len`` symbols with the row before?

    Backward extension of row intervals, by rounds of one symbol. ``known[r]``: the common prefix of rows
    r-1 and r is shorter than ``min_len`` and was derived in an earlier round.
    """
    n = len(order)
    bwt = text[order - 1]  # the symbol before each suffix; before the first one stands a separator
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    step[by_symbol] = np.arange(n)
    nxt, prev = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and previous row of the same symbol
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    nxt[by_symbol[:-1][same]] = by_symbol[1:][same]
    prev[by_symbol[1:][same]] = by_symbol[:-1][same]
    extends = bwt != 0  # matches don't cross separators
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    # separators all differ: each is an interval of its own, of one symbol, with boundaries of length 0
    seps = int((text == 0).sum())
    known[: seps + 1] = True
    low, high = np.array([0]), np.array([n - 1])
    for length in range(min_len):  # sets the boundaries of common prefixes of this length
        if length == 1:
            low, high = np.r_[np.arange(seps), low], np.r_[np.arange(seps), high]
        if not len(low):
            break
        counts = high - low + 1
        ends = np.cumsum(counts)
        rows = np.arange(ends[-1]) - np.repeat(ends - counts - low, counts)
        of_low, of_high = np.repeat(low, counts), np.repeat(high, counts)
        ok = extends[rows]
        first = rows[ok & (prev[rows] < of_low)]
        last = rows[ok & (nxt[rows] > of_high)]
        # intervals of one length don't overlap: sorted lower and upper ends belong together
        low, high = np.sort(step[first]), np.sort(step[last])
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    return ~known[:n]


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur at two places of all the strings."""
    sizes = np.array([len(x) for x in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(strings), np.uint16)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text[:] = raw
    text += 1
    text[starts + sizes] = 0
    order = suffix_order(text, window)
    shared = shared_rows(text, order, window)
    hit = np.zeros(len(text), bool)
    hit[order[shared]] = True
    hit[order[:-1][shared[1:]]] = True
    return [hit[s : s + max(0, n - window + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(did, h, spans): the byte spans to remove, for documents that have any."""
    return repeated_spans(docs, id_col, text_col, False, min_bytes, max(1, min(KGRAM, min_bytes - 1)), repeated_windows)


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("body"))
            view = memoryview(raw)
            out = []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                text = view[offsets[row] : offsets[row + 1]]
                cuts = merge(spans)
                digest, at, keep = hashlib.sha256(), 0, []
                for s, e in [*cuts, (len(text), len(text))]:
                    digest.update(text[at:s])
                    keep.append(text[at:s])
                    at = e
                out.append((len(text), sum(e - s for s, e in cuts), len(cuts), digest.hexdigest(), b"".join(keep) if with_text else None))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield arrow_rows(OUT, doc_id=batch.column("doc_id"), **dict(zip(OUT.names[1:], cols, strict=True)))
    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, with_text: bool = True) -> DataFrame:
    """One row for each document: its length, what was removed, and the remaining bytes (null without ``with_text``).

    The remaining bytes may not be valid UTF-8, as cuts fall between any two bytes.
    """
    spans = repeated_bytes(docs, id_col, text_col, min_bytes)
    own = keyed(docs, id_col, text_col, docs[id_col].cast("long").alias("doc_id"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return own.join(spans, ["did", "h"], "left").select("doc_id", "body", "spans").mapInArrow(_cut(with_text), ddl)
