"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

File format, integers little-endian. A record is
    uint64 length | uint32 masked checksum of the length's 8 bytes | data | uint32 masked checksum of data
and data is uint8 flags | int64 document id | token ids, the end id last. Flag 1: the document has an id. Flag 2: token
ids are uint32; without it all of the record's ids are below 65536 and are uint16.
A masked checksum is rotr(crc32, 15) + 0xA282EAD8 modulo 2**32, so that checksums of data that hold checksums
stay useful. Beside each data file lies ``.idx``: the uint64 offset of each record and the data file's length, so
that any record can be read by itself, in any order.

Files hold documents in ascending id order, the first file the lowest ids. A task writes under a name of its own and
only finished tasks report their files, so repeated or lost tasks leave no wrong file in the result.

Defined cases: null texts are empty (end id only); a null id sorts first and stays null; rows that repeat an id are
ordered by their text's hash; an empty table gives no files and no rows; other columns are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import scratch_dir

from .common import arrow_rows, materialize

END_ID = 2
MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(doc_id: int | None, ids: bytes) -> bytes:
    """``ids``: little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    large = len(wide) > 0 and int(wide.max()) > 0xFFFF
    flags = (doc_id is not None) + 2 * large
    data = b"".join((bytes([flags]), (doc_id or 0).to_bytes(8, "little", signed=True), ids if large else wide.astype("<u2").tobytes()))
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), data, masked(data).to_bytes(4, "little")))


def read_record(f, at: int | None = None) -> tuple[int | None, bytes] | None:
    """(document id, ids as unsigned 32-bit bytes) of the record at an offset or at the file's place; None at the end."""
    if at is not None:
        f.seek(at)
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("damaged record length")
    n = int.from_bytes(head[:8], "little")
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
        raise ValueError("damaged record")
    ids = body[9:n] if body[0] & 2 else np.frombuffer(body, "<u2", (n - 9) // 2, 9).astype("<u4").tobytes()
    return int.from_bytes(body[1:9], "little", signed=True) if body[0] & 1 else None, ids


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .encoding import encoder

        encode = encoder(tokenizer)
        fs, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.rec"
        out, offsets, at, n_ids = None, [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out = out or fs.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                ids = (encode(text) if text else b"") + end
                data = record(doc_id, ids)
                out.write(data)
                offsets.append(at)
                at += len(data)
                n_ids += len(ids) // 4
        if out:
            out.close()
            with fs.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(np.array([*offsets, at], "<u8").tobytes())
            yield arrow_rows(MANIFEST, part=[part], file=[name], n_docs=[len(offsets)], n_ids=[n_ids], n_bytes=[at])
    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes all documents in ascending id order; returns the manifest (part, file, n_docs, n_ids, n_bytes)."""
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    n = max(1, docs.select(text_col).rdd.getNumPartitions())  # of the scan: no job
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # rows that repeat an id, even with the same text, can still be dealt to several files
    dealt = own.repartitionByRange(n, F.asc_nulls_first("doc_id"), "h", F.spark_partition_id()).sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")
    return materialize(dealt.select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id), "part int, file string, n_docs long, n_ids long, n_bytes long"), "manifest")


def _read(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", buffer_size=1 << 20) as f:
                    while (got := read_record(f)) is not None:
                        doc_id, ids = got
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        start += len(ids) // 4
                        size += 64 + len(ids) * with_ids
                        if size > 1 << 23:
                            yield arrow_rows(READ, **dict(zip(READ.names, zip(*rows, strict=True), strict=True)))
                            rows, size = [], 0
                if rows:
                    yield arrow_rows(READ, **dict(zip(READ.names, zip(*rows, strict=True), strict=True)))
    return run


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every record, each checked. One task reads whole files."""
    spark = manifest.sparkSession
    files, start = [], 0
    for r in manifest.select("part", "file", "n_ids").orderBy("part").collect():  # one row a file
        files.append((r["file"], start))
        start += r["n_ids"]
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not files:
        return spark.createDataFrame([], ddl)
    listed = spark.createDataFrame(files, "file string, start long").repartition(len(files))
    return listed.mapInArrow(_read(folder, with_ids), ddl)


def read_at(folder: str, name: str, numbers: list[int]) -> list[tuple[int | None, bytes]]:
    """Records of one file by number, in the order asked for, by the offset index."""
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/{name}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(f"{path}/{name}") as f:
        return [read_record(f, int(offsets[i])) for i in numbers]


def token_records(docs: DataFrame, tokenizer: str, with_ids: bool = False, **kw) -> DataFrame:
    """Writes the documents to a new folder in the shared scratch space and reads them back."""
    folder = scratch_dir(docs.sparkSession, "llm-records")
    return read_records(write_records(docs, tokenizer, folder, **kw), folder, with_ids)
