"""Many files read together: one scan for all files of a layout, malformed rows set aside with a reason.

``layouts`` finds in one job which files share their columns (a CSV header, the keys of a JSON object), so that the
number of scans is the number of different layouts, not of files. Every row carries its file's path.

``read_checked`` reads a text format without dropping or bending anything: a row that doesn't fit the schema goes to
a side table with its file, its text and the reason; good and bad rows together are the rows of the files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Columns that rows carry beside those of their file.
PATH, START, AT = "__report_path", "__report_start", "__report_row"
BAD = "__bad_row"
TEXT_FORMATS = {"csv": "csv", "ndjson": "json", "json": "json"}
FORMATS = {*TEXT_FORMATS, "parquet"}


@dataclass
class Layout:
    """Files of one format whose columns have the same names in the same order."""
    fmt: str
    columns: str
    paths: list[str]


def extension(path: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def folder_files(spark: SparkSession, folder: str, formats: set[str]) -> list[tuple[str, int]]:
    """(path as Spark names it, bytes) of the files directly in a folder, empty ones too, in order of path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile()]
    return sorted((x, n) for x, n in found if x.rsplit(".", 1)[-1].lower() in formats and not x.rsplit("/", 1)[-1].startswith(("_", ".")))


def layouts(spark: SparkSession, paths: list[str]) -> tuple[list[Layout], list[str]]:
    """(layouts, paths of empty files). CSV and JSON lines files are told apart by their first line, in one job for all.

    Parquet files are one layout, with the columns of all of them. Only first lines and paths reach the driver, whose
    file listing holds the paths anyway.
    """
    kind = {p: p.rstrip("/").rsplit(".", 1)[-1].lower() for p in paths}
    text = sorted(p for p in paths if kind[p] in TEXT_FORMATS)
    out = [Layout("parquet", "", sorted(p for p in paths if kind[p] == "parquet"))]
    found: set[str] = set()
    if text:
        rows = spark.read.text(text).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                           F.monotonically_increasing_id().alias("at"))
        rows = rows.where((F.col("start") == 0) & (F.trim("value") != ""))
        first = rows.groupBy("path").agg(F.min_by("value", "at").alias("line"))
        fmt = extension(F.col("path"))
        # a JSON array gives no keys by its first line: such files share a layout only with each other
        names = F.when(fmt == "csv", F.col("line")).otherwise(F.coalesce(F.array_join(F.json_object_keys("line"), ","), F.lit("[")))
        for r in first.select("path", fmt.alias("fmt"), names.alias("names")).groupBy("fmt", "names").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("fmt", "names").collect():
            out.append(Layout(r["fmt"], r["names"], r["paths"]))
            found.update(r["paths"])
    # compared by their ends, as listed paths may lack the scheme that Spark's have
    empty = [p for p in text if not any(q == p or q.endswith(p if p.startswith("/") else "/" + p.split("://", 1)[-1]) for q in found)] if len(found) < len(text) else []
    return [x for x in out if x.paths], empty


def read_layout(spark: SparkSession, layout: Layout, schema: StructType | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows with PATH, START and AT, malformed rows or None) of all files of a layout, in one scan after the types' one."""
    if layout.fmt == "parquet":
        return placed(spark.read.option("mergeSchema", "true").parquet(*layout.paths)), None
    return read_checked(spark, layout.paths, layout.fmt, schema, multiline=layout.columns == "[")


def placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.file_block_start").alias(START), F.monotonically_increasing_id().alias(AT))


def read_checked(spark: SparkSession, paths: str | list[str], fmt: str, schema: StructType | None = None, multiline: bool = False,
                 **opts) -> tuple[DataFrame, DataFrame]:
    """(good rows with PATH, START and AT, bad rows: path, row, reason) of text files of one layout.

    Without ``schema`` the types are inferred from all rows, so that only rows of another shape are bad; with it also
    those with a value that doesn't fit. The parsed rows are persisted, as Spark can't ask raw text for its malformed
    rows alone; they are recomputed where an executor is lost. Unpersist ``good`` through ``release``.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"rows can be checked in {', '.join(sorted(TEXT_FORMATS))}, not in {fmt}")
    base = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, **opts}
    base |= {"header": "true", "enforceSchema": "false"} if fmt == "csv" else {"multiLine": str(multiline).lower()}
    if schema is None:
        known = (spark.read.options(**base).csv(paths, inferSchema=True) if fmt == "csv" else spark.read.options(**base).json(paths)).schema
        schema = StructType([f for f in known.fields if f.name != BAD])
    whole = StructType([*schema.fields, StructField(BAD, StringType())])
    reader = spark.read.schema(whole).options(**base)
    parsed = placed(reader.csv(paths) if fmt == "csv" else reader.json(paths)).persist(StorageLevel.MEMORY_AND_DISK)
    good = parsed.where(F.col(BAD).isNull()).drop(BAD)
    if fmt == "csv":
        sep = opts.get("sep", ",")
        outside = f'{"[" + sep + "]" if sep != "|" else "[|]"}(?=(?:[^"]*"[^"]*")*[^"]*$)'  # separators outside quotes
        fields = F.regexp_count(BAD, F.lit(outside)) + 1
        reason = F.when(fields != len(schema.fields), F.concat(fields.cast("string"), F.lit(f" fields instead of {len(schema.fields)}"))).otherwise("a value does not fit its column")
    else:
        reason = F.when(F.json_object_keys(BAD).isNull() & ~F.lit(multiline), "not a JSON object").otherwise("a value does not fit its column")
    bad = parsed.where(F.col(BAD).isNotNull()).select(F.col(PATH).alias("path"), F.col(BAD).alias("row"), reason.alias("reason"))
    good._checked_rows = parsed  # noqa: SLF001 - kept so that release() can find it
    return good, bad


def release(good: DataFrame) -> None:
    held = getattr(good, "_checked_rows", None)
    if held is not None:
        held.unpersist()


def reconcile(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(path, good, bad, rows): rows of each file that were read and that were set aside."""
    both = good.select(F.col(PATH).alias("path"), F.lit(1).alias("g")).unionByName(bad.select("path", F.lit(0).alias("g")))
    return both.groupBy("path").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"), F.count(F.lit(1)).alias("rows"))
