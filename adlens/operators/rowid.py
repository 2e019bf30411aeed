"""Consecutive row numbers without a global sort into one task.

The input is first checkpointed to the shared folder, so that counting and
numbering see the same rows in the same partitions: a plan that ends in a
shuffle may be coalesced differently each time it runs. One job then counts
the rows of each partition (one small row per partition reaches the driver),
and the running offsets are a small table joined back on the partition id
(its size is the partition count, not the data size). With ``order_by`` the
rows are range-partitioned and sorted first (Spark's distributed sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import ensure_checkpoint_dir


def row_index(df: DataFrame, name: str = "row_id", start: int = 1, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, ...; raises if the numbered rows aren't as many as the input's."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = (df.orderBy(*order_by) if order_by else df).checkpoint(eager=True)
    tagged = df.withColumns({"__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()})
    counts = sorted(tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], start
    for r in counts:
        offsets.append((int(r["__pid"]), run))
        run += int(r["n"])
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    off = spark.createDataFrame(offsets, "__pid int, __off long")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    out = (
        tagged.join(F.broadcast(off), "__pid")
        .withColumn(name, F.col("__off") + local)
        .drop("__pid", "__mid", "__off")
    )
    seen = out.agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    if (seen["n"], seen["lo"], seen["hi"]) != (run - start, start, run - 1):
        raise RuntimeError(f"row numbering lost rows: {seen} of {run - start}")
    return out
