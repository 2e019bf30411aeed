"""W3 by state: a file is taken once its length and time of change have stayed the same for a while.

A clock stream (Spark's ``rate`` source) gives the ticks. Each tick lists the folder by a Spark job that reads no contents and
joins the listing to the ledger of the tick before, one row for each path: length, time of change, since when both stand, and
whether the file was taken. A file that stands long enough is ready; at most ``max_files`` ready files are taken in a tick, the
oldest first, and the others wait for the next one. No thread sleeps for a file, and the wait goes on over a restart, as the
ledger is on disk and the clock's time is in the checkpoint.

The ledger of a tick is written before its files are handled, in a folder named by the tick. A tick that is run again starts
from the ledger before it, so its files are ready again (at-least-once) and the handler, which names its output by the tick,
replaces what it wrote. A path is taken once, even if it is overwritten later, like the plain watcher does. A path that is gone
leaves the ledger: a file that comes back under that name is a new one. Empty files are taken, too; their report is an error.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adlens.plans.pipeline import _drop_folder
from adlens.plans.publish import _names
from adlens.sources.readers import LEAN_FORMATS, WIDE_FORMATS
from adlens.streaming.folder import LISTING_SCHEMA, _handler

LEDGER = "path string, modificationTime timestamp, length bigint, since timestamp, taken boolean"


def listing(spark: SparkSession, folder: str, profile: str = "lean") -> DataFrame:
    """Supported files directly in the folder, as they are now."""
    exts = sorted(LEAN_FORMATS if profile == "lean" else WIDE_FORMATS)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").schema(LISTING_SCHEMA).load(folder)
    return files.select("path", "modificationTime", "length").where(ext.isin(exts))


def settle(files: DataFrame, before: DataFrame, now, settle_seconds: float, max_files: int) -> DataFrame:
    """The next ledger, with ``ready`` marking the files that are taken in this tick."""
    b = before.select("path", *[F.col(c).alias(f"b_{c}") for c in ("modificationTime", "length", "since", "taken")])
    same = F.col("length").eqNullSafe(F.col("b_length")) & F.col("modificationTime").eqNullSafe(F.col("b_modificationTime"))
    tick = F.lit(now).cast("timestamp")
    led = files.join(b, "path", "left").select(
        "path", "modificationTime", "length",
        F.when(same, F.col("b_since")).otherwise(tick).alias("since"), F.coalesce("b_taken", F.lit(False)).alias("taken"))
    stands = (F.unix_micros(tick) - F.unix_micros("since")) >= int(settle_seconds * 1_000_000)
    ready = led.where(~F.col("taken") & stands).orderBy("since", "path").limit(max_files).select("path", F.lit(True).alias("ready"))
    return (led.join(ready, "path", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
            .withColumn("taken", F.col("taken") | F.col("ready")))


def tick_handler(folder: str, ledger_dir: str, handle: Callable[[DataFrame, int], None], settle_seconds: float = 2.0,
                 max_files: int = 100, profile: str = "lean") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` of the clock; ``handle`` gets the files taken (path, modificationTime, length) and the tick's number."""
    base = ledger_dir.rstrip("/")

    def each_tick(clock: DataFrame, n: int) -> None:
        spark = clock.sparkSession
        now = clock.agg(F.max("timestamp")).first()[0]
        if now is None:
            return
        before, last = spark.createDataFrame([], LEDGER), None
        if _names(spark, base):  # the clock's first batches may be empty
            old = spark.read.schema(f"{LEDGER}, ready boolean, tick bigint").parquet(base).where(F.col("tick") < n)
            last = old.agg(F.max("tick")).first()[0]
            if last is not None:
                before = old.where((F.col("tick") == last) & F.col("path").isNotNull()).select("path", "modificationTime", "length", "since", "taken")
        led = settle(listing(spark, folder, profile), before, now, settle_seconds, max_files)
        # a row without a path shows that the tick was finished, also where the folder is empty
        done = spark.range(1).select(F.lit(False).alias("ready"))
        led.unionByName(done, allowMissingColumns=True).write.mode("overwrite").parquet(f"{base}/tick={n}")
        handle(spark.read.parquet(f"{base}/tick={n}").where("ready").select("path", "modificationTime", "length"), n)
        if last is not None:  # this tick and the one before are enough to go on from
            for t in [r[0] for r in old.where(F.col("tick") < last).select("tick").distinct().collect()]:
                _drop_folder(spark, f"{base}/tick={t}")

    return each_tick


def watch_settled(spark: SparkSession, folder: str, out_dir: str, checkpoint: str, settle_seconds: float = 2.0,
                  interval: str = "1 second", profile: str = "lean", max_files: int = 100, **kw) -> StreamingQuery:
    """W1-W6 with the wait kept as state: reports of the files of a folder, each once it stands still. ``query.stop()`` is W7."""
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    reports = _handler(out_dir, profile, settle_seconds=0, **kw)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    step = tick_handler(folder, f"{out_dir.rstrip('/')}/_ledger", reports, settle_seconds, max_files, profile)
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
