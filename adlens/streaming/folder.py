"""Build a report for every file that arrives in a folder.

One listing stream serves all formats: Spark's ``binaryFile`` source with only
``path``, ``modificationTime`` and ``length`` selected (file contents are not
read by the stream), filtered to the supported extensions. Each micro-batch
(``foreachBatch``) reads each new file on its own with the batch readers and
runs the pipeline, so every file keeps its own format and inferred schema. A
failure is caught per file and logged; the stream lives on.

Batches are at-least-once; a re-executed batch writes the same partitions
again (run id = batch id, dynamic partition overwrite), so reports and log
rows are not duplicated. What the checkpoint gives: every path is taken once,
across restarts, even if
the file is later overwritten (stronger than the reference's 5 s per-path
cooldown). A file that is still being written is waited for until its length
stays the same (``wait_complete``). The files of a batch are handled by a bounded
number of threads, each submitting Spark jobs (``parallel_files``). Failed
files are in the log table with their error and can be re-run in batch with
``retry_failed``.

Backlog then live (W6) is the same stream: ``trigger="availableNow"`` drains
what is there, ``trigger="processingTime"`` keeps watching. ``maxFilesPerTrigger``
bounds the listing rows a micro-batch brings to the driver.
"""

from __future__ import annotations

import datetime as _dt
import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adlens.plans.pipeline import process_file
from adlens.session import scratch_dir
from adlens.sources.readers import LEAN_FORMATS, WIDE_FORMATS, read_folder

LISTING_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LOG_SCHEMA = "path string, batch_id long, status string, error string, report_id string, processed_at string"


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def listing_stream(spark: SparkSession, folder: str, profile: str = "lean", max_files: int = 100) -> DataFrame:
    """W1 + W2: new files directly in ``folder`` with a supported extension."""
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    exts = sorted(LEAN_FORMATS if profile == "lean" else WIDE_FORMATS)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (
        spark.readStream.format("binaryFile").schema(LISTING_SCHEMA)
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", "modificationTime", "length")
        .where(ext.isin(exts))
    )


def wait_complete(spark: SparkSession, path: str, length: int, settle_seconds: float, modified=None, most: float = 60.0) -> None:
    """Returns once the file's length has stayed the same for ``settle_seconds`` (at once if it is that old already)."""
    if settle_seconds <= 0:
        return
    if modified is not None and (_dt.datetime.now() - modified).total_seconds() > settle_seconds + 1:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = time.monotonic() + most
    while time.monotonic() < end:
        time.sleep(settle_seconds)
        now = fs.getFileStatus(p).getLen()
        if now == length:
            return
        length = now
    raise TimeoutError(f"still being written after {most:g} s: {path}")


def _handler(out_dir: str, profile: str, parallel_files: int = 4, settle_seconds: float = 0.5, **kw):
    log_path = f"{out_dir.rstrip('/')}/_log"

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = batch.select("path", "modificationTime", "length").collect()  # <= maxFilesPerTrigger rows

        def one(row) -> tuple:
            p, now = row["path"], _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="seconds")
            try:
                wait_complete(spark, p, row["length"], settle_seconds, row["modificationTime"])
                # run id = batch id: a re-executed batch overwrites its own report partitions
                res = process_file(spark, _local(p), out_dir, profile=profile, run_ts=f"batch{batch_id}", **kw)
                return (p, batch_id, "ok", None, res["report_id"], now)
            except Exception as e:  # noqa: BLE001 - W5: one bad file must not stop the watcher
                return (p, batch_id, "error", f"{type(e).__name__}: {e}", None, now)

        # jobs of several files run side by side; each thread submits Spark jobs only
        with ThreadPoolExecutor(max_workers=max(1, min(parallel_files, len(found) or 1))) as pool:
            log = list(pool.map(inheritable_thread_target(spark)(one), sorted(found, key=lambda r: r["path"])))
        if log:
            # partitioned by batch and overwritten dynamically: at-least-once batches log once
            (spark.createDataFrame(log, LOG_SCHEMA).withColumn("batch", F.col("batch_id"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch").parquet(log_path))

    return each_batch


def watch_folder(spark: SparkSession, folder: str, out_dir: str, checkpoint: str | None = None,
                 trigger: str = "availableNow", interval: str = "5 seconds", profile: str = "lean",
                 max_files: int = 100, **kw) -> StreamingQuery:
    """Start the watcher; ``query.stop()`` is W7."""
    ckpt = checkpoint or scratch_dir(spark, "watch-ckpt")
    w = listing_stream(spark, folder, profile, max_files).writeStream.foreachBatch(
        _handler(out_dir, profile, **kw)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=interval)
    return w.start()


def read_log(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/_log").drop("batch")


def retry_failed(spark: SparkSession, out_dir: str, profile: str = "lean", **kw) -> list[tuple]:
    """Re-run, in batch, the files whose last log entry is an error."""
    log = read_log(spark, out_dir)
    from pyspark.sql import Window
    last = log.withColumn("rk", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("processed_at"),
                                                                                      F.desc("batch_id"))))
    failed = sorted(r["path"] for r in last.where("rk = 1 AND status = 'error'").select("path").collect())
    out = []
    for p in failed:
        try:
            res = process_file(spark, _local(p), out_dir, profile=profile, **kw)
            out.append((p, "ok", res["report_id"]))
        except Exception as e:  # noqa: BLE001
            out.append((p, "error", f"{type(e).__name__}: {e}"))
    return out


def process_existing(spark: SparkSession, folder: str, out_dir: str, profile: str = "lean", **kw) -> list[tuple]:
    """S9 in batch: each supported file alone, failures isolated."""
    from adlens.plans.pipeline import analyze, release, report_id_of, stem_of, write_report
    out = []
    for p, df, err in read_folder(spark, folder, profile):
        if df is None:
            out.append((p, "error", err))
            continue
        try:
            t = analyze(df, profile=profile, title_stem=stem_of(p), **kw)
            try:
                write_report(t, out_dir, report_id_of(p))
            finally:
                release(t)
            out.append((p, "ok", None))
        except Exception as e:  # noqa: BLE001
            out.append((p, "error", f"{type(e).__name__}: {e}"))
    return out
