"""S10 and S11 from Parquet footers: counts, minima and maxima without reading a single column.

Spark can answer such aggregates from the row groups' statistics in the files' footers, if the table is read by its
newer file source and nothing is filtered. The setting is made in a session of its own, so the caller's stays as it is.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types whose minimum and maximum the footers hold in full (text can be cut there).
ORDERED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date"}
SETTINGS = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}


def footer_aggregate(spark: SparkSession, path: str, scan: bool = False) -> DataFrame:
    """One row: the number of rows, and for each column its values that aren't null and, if ordered, its ends.

    ``scan``: the same by reading the columns.
    """
    own = spark.newSession()
    for k, v in ({} if scan else SETTINGS).items():
        own.conf.set(k, v)
    df = own.read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (c, t) in enumerate(df.dtypes):
        if t in ORDERED:
            aggs += [F.min(f"`{c}`").alias(f"lo{i}"), F.max(f"`{c}`").alias(f"hi{i}")]
        if not t.startswith(("array", "map", "struct")):
            aggs.append(F.count(f"`{c}`").alias(f"n{i}"))
    return df.agg(*aggs)


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, column_name, dtype, row_count, null_count, min, max) of a Parquet table, as text where it is shown.

    ``min`` and ``max`` are null for types without such statistics, ``null_count`` for nested columns. Where a footer
    lacks what is asked for (a column that is null throughout a row group has no ends), the columns are read instead.
    """
    try:
        row = footer_aggregate(spark, path).first().asDict()
    except (Py4JJavaError, PySparkException) as e:
        if "found for" not in str(e) and "FAILED_READ_FILE" not in str(e):
            raise
        row = footer_aggregate(spark, path, scan=True).first().asDict()
    dtypes = spark.read.parquet(path).dtypes
    text = lambda x: None if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    rows = [(i, c, t, row["rows"], None if f"n{i}" not in row else row["rows"] - row[f"n{i}"], text(row.get(f"lo{i}")), text(row.get(f"hi{i}")))
            for i, (c, t) in enumerate(dtypes)]  # one for each column
    return spark.createDataFrame(rows, "ordinal int, column_name string, dtype string, row_count long, null_count long, min string, max string")
