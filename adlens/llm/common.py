"""Shared helpers: scratch tables, row keys and Arrow access to whole texts as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.session import scratch_dir

#: Text bytes that one numpy step works on; longer documents are handled in overlapping segments.
STEP_BYTES = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write into ``path`` was committed."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(col: Column, text: Column) -> Column:
    """A non-null long for joins on an integer id; rows without an id are told apart by their text."""
    return F.coalesce(col.cast("long"), F.xxhash64(text))


def text_key(col: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.coalesce(F.hash(col), F.lit(0))


def hash_sample(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """About ``size`` of the distinct keys of ``rows``, with all their rows and the key's hash as column ``o``.

    The number of keys comes from a sketch and sets a cut that hashes must lie below, so nothing is sorted or gathered.
    """
    hashed = rows.withColumn("o", key)
    n = hashed.agg(F.approx_count_distinct("o", 0.02)).first()[0]
    return hashed if n <= size else hashed.filter(F.col("o") < int(size / n * 2**64) - 2**63)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values end to end, offsets with one more entry than rows) of a binary column; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"")
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes together, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


SPACES = b" \t\n\r\x0b\x0c"


def text_parts(body: memoryview, size: int = STEP_BYTES) -> Iterator[bytes]:
    """One text in parts of about ``size`` bytes that end at white space, as far as it has any."""
    at = 0
    while at < len(body):
        end = min(at + size, len(body))
        held = [bytes(body[at:end])]
        while end < len(body) and body[end] not in SPACES:  # to the end of the word
            more = bytes(body[end : end + 4096])
            cut = next((i for i, b in enumerate(more) if b in SPACES), len(more))
            held.append(more[:cut])
            end += cut
        yield b"".join(held)
        at = end


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then the same for the next, end to end."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - counts - starts, counts)
