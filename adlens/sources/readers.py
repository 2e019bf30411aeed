"""File and database readers.

``read_any`` picks a reader by extension; the lean set is csv, json, ndjson,
parquet and sqlite/db/sqlite3, the wide set csv, json, parquet. A ``.json``
file is read as a JSON array or as JSON lines depending on its first
non-blank character (Spark's ``multiLine=True`` on JSON lines silently keeps
the first record, and ``multiLine=False`` on an array gives corrupt-record
rows, so the choice must be made up front).

SQLite has no JDBC driver here, so it is a PySpark Python Data Source: the
reader splits the table into rowid ranges, one input partition each, and every
task opens the file read-only. The file must be on a path all executors can
read (a shared folder on a cluster).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEAN_FORMATS = {"csv": "csv", "json": "json", "ndjson": "ndjson", "parquet": "parquet",
                "sqlite": "sqlite", "db": "sqlite", "sqlite3": "sqlite"}
WIDE_FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet"}


# --------------------------------------------------------------------------- SQLite data source

_SQLITE_TYPES = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUM": "double",
                 "DEC": "double", "BOOL": "boolean"}


def _sqlite_type(decl: str) -> str:
    d = (decl or "").upper()
    for k, t in _SQLITE_TYPES.items():
        if k in d:
            return t
    return "string"


def _connect(path: str):
    import sqlite3
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _first_table(con) -> str | None:
    r = con.execute("SELECT name FROM sqlite_master WHERE type='table' ORDER BY rowid LIMIT 1").fetchone()
    return r[0] if r else None


@dataclass
class _RowidRange(InputPartition):
    lo: int
    hi: int


class SqliteDataSource(DataSource):
    """``spark.read.format("sqlite").option("path", p).option("table", t).option("partitions", n).load()``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self, con) -> str:
        t = self.options.get("table") or _first_table(con)
        if not t:
            raise ValueError(f"{self.options.get('path')} holds no table")
        return t

    def schema(self) -> str:
        con = _connect(self.options["path"])
        try:
            t = self._table(con)
            cols = con.execute(f'PRAGMA table_info("{t}")').fetchall()
        finally:
            con.close()
        return ", ".join(f"`{c[1]}` {_sqlite_type(c[2])}" for c in cols)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.table = options.get("table")
        self.n = int(options.get("partitions", "4"))
        self.cols = [f.name for f in schema.fields]
        self.types = [f.dataType.simpleString() for f in schema.fields]

    def _tbl(self, con) -> str:
        return self.table or _first_table(con)

    def partitions(self):
        con = _connect(self.path)
        try:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self._tbl(con)}"').fetchone()
        finally:
            con.close()
        if lo is None:
            return [_RowidRange(0, -1)]
        step = max(1, (hi - lo + self.n) // self.n)
        return [_RowidRange(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _RowidRange):
        con = _connect(self.path)
        try:
            cols = ", ".join(f'"{c}"' for c in self.cols)
            cur = con.execute(
                f'SELECT {cols} FROM "{self._tbl(con)}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid',
                (partition.lo, partition.hi))
            conv = [float if t == "double" else (int if t == "bigint" else (bool if t == "boolean" else str))
                    for t in self.types]
            for row in cur:
                yield tuple(None if v is None else f(v) for v, f in zip(row, conv))
        finally:
            con.close()


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteDataSource)


# --------------------------------------------------------------------------- dispatch

def _files_below(fs, found):
    """Files of a listing and of the folders in it, looked up as they are asked for; hidden names are left out."""
    for status in found:
        if status.isFile():
            yield status.getPath()
        else:
            yield from _files_below(fs, [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))])


def _json_is_array(spark: SparkSession, path: str, chunk: int = 4096) -> bool:
    """Whether the first character that isn't blank is a bracket. Reads as many bytes as that takes, of one file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in _files_below(fs, list(fs.globStatus(p) or [])):
        stream = fs.open(file)
        try:
            while head := bytes(stream.readNBytes(chunk)):
                head = head.lstrip(b"\xef\xbb\xbf \t\r\n")
                if head:
                    return head[:1] == b"["
        finally:
            stream.close()
    return False


def read_any(spark: SparkSession, path: str, fmt: str | None = None, profile: str = "lean",
             table: str | None = None, schema=None, **opts) -> DataFrame:
    """Read by extension (or ``fmt``); missing -> FileNotFoundError, empty -> ValueError.

    Text formats infer their schema, which is a full pass over the input; for
    very large CSV/JSON pass ``schema`` (DDL or StructType) or ``samplingRatio``.
    """
    allowed = LEAN_FORMATS if profile == "lean" else WIDE_FORMATS
    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    kind = allowed.get(ext)
    if kind is None:
        raise ValueError(f"no reader for .{ext} files in the {profile} profile (it has: {', '.join(sorted(allowed))})")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    # a row that does not fit the schema is an error, not nulls or a cut row
    opts = {"mode": "FAILFAST", **opts} if kind in ("csv", "ndjson", "json") else opts
    try:
        if kind == "csv":
            df = reader.options(header=True, inferSchema=schema is None, enforceSchema=False, **opts).csv(path)
        elif kind == "parquet":
            df = reader.options(**opts).parquet(path)
        elif kind == "ndjson":
            df = reader.options(multiLine=False, **opts).json(path)
        elif kind == "json":
            df = reader.options(multiLine=_json_is_array(spark, path), **opts).json(path)
        else:
            if "://" not in path and not os.path.exists(path):
                raise FileNotFoundError(path)
            register_sources(spark)
            r = spark.read.format("sqlite").option("path", path)
            if table:
                r = r.option("table", table)
            df = r.options(**opts).load()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise RuntimeError(f"{path} can't be read as {kind}: {e}") from e
    if "_corrupt_record" in df.columns:
        raise RuntimeError(f"{path} has rows that are no {kind} records")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def load_metadata(df: DataFrame, source: str, fmt: str, rows: int | None = None) -> dict:
    """Source, format, shape and dtypes (``rows`` from a pass already made, else counted)."""
    return {
        "source": source, "format": fmt, "rows": df.count() if rows is None else rows,
        "columns": len(df.columns), "column_names": list(df.columns), "dtypes": dict(df.dtypes),
    }


def list_folder(spark: SparkSession, folder: str, profile: str = "lean") -> list[str]:
    """S9 listing: supported files directly in ``folder`` (not recursive), sorted.

    Listed by Spark's binary-file source with only path/length selected, so the
    file contents are not read.
    """
    exts = sorted(LEAN_FORMATS if profile == "lean" else WIDE_FORMATS)
    try:
        files = spark.read.format("binaryFile").load(folder).select("path")
    except AnalysisException:
        return []
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return sorted(r["path"] for r in files.where(ext.isin(exts)).collect())


def read_folder(spark: SparkSession, folder: str, profile: str = "lean") -> list[tuple[str, DataFrame | None, str | None]]:
    """Every supported file on its own; one failure does not stop the rest."""
    out = []
    for p in list_folder(spark, folder, profile):
        local = p[len("file:"):] if p.startswith("file:") else p
        try:
            out.append((p, read_any(spark, local, profile=profile), None))
        except Exception as e:  # noqa: BLE001 - isolation per file is the feature
            out.append((p, None, f"{type(e).__name__}: {e}"))
    return out
