"""WX1 in append form: a day's totals come out once, when the day is closed, and rows that come after that go to a side table.

Spark's own append mode drops late rows without a trace, so the mark up to which event time is closed is kept here, beside the
open days' totals. Micro-batch n reads the ledger of batch n - 1 (open days and the mark), splits its rows into on time and
late by that mark, adds the on-time partial totals to the open days, moves the mark and closes the days that end at or before
it. It writes its late rows first and its ledger last, each into a folder named by the batch, so a batch that is run again
(at-least-once) replaces its own output, and rows of a batch whose ledger was never written are not read.

The ledger has one row for each open day, the days closed in that batch and the mark: its size follows the calendar. Rows are
summed before the shuffle, so a hot day sends one partial row a task. Late rows are read by a filter on the time only if the
totals show that there are any.

A row without a time can't be on time: it goes to the side table with a null day. Days are closed whole: a row of an open day
is on time however old it is.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adlens.streaming.daily import EVENTS_SCHEMA

TOTALS = ["events", "views", "clicks", "purchases", "value_sum"]
LEDGER = "kind string, day date, events bigint, views bigint, clicks bigint, purchases bigint, value_sum double, mark timestamp_ntz"


def day_partials(events: DataFrame) -> DataFrame:
    """Totals of each day and the newest time in it."""
    return events.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.sum("value").alias("value_sum"),
        F.max("ts").alias("newest"),
    )


def closed_at(day: Column, mark: _dt.datetime | None) -> Column:
    """Whether the day ends at or before the mark."""
    if mark is None:
        return F.lit(False)
    return F.date_add(day, 1).cast("timestamp_ntz") <= F.lit(mark).cast("timestamp_ntz")


def _ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(f"{LEDGER}, batch bigint").parquet(f"{out_dir.rstrip('/')}/ledger")


def _handler(out_dir: str, lateness: _dt.timedelta):
    base = out_dir.rstrip("/")

    def each_batch(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _ledger(spark, base).where(F.col("batch") == n - 1).drop("batch") if n else spark.createDataFrame([], LEDGER)
        mark = before.agg(F.max("mark")).first()[0]
        late = F.col("day").isNull() | closed_at(F.col("day"), mark)
        partials = day_partials(batch).persist()
        try:
            newest, any_late = partials.agg(F.max("newest"), F.coalesce(F.bool_or(late), F.lit(False))).first()
            if any_late:
                day = F.col("ts").cast("date")
                (batch.where(day.isNull() | closed_at(day, mark)).withColumn("day", day)
                 .write.mode("overwrite").parquet(f"{base}/late/batch={n}"))
            ahead = [m for m in (mark, newest - lateness if newest is not None else None) if m is not None]
            mark = max(ahead) if ahead else None
            days = (before.where("kind = 'open'").select("day", *TOTALS).unionByName(partials.where(~late).select("day", *TOTALS))
                    .groupBy("day").agg(*[F.sum(c).alias(c) for c in TOTALS]))
            days = days.select(F.when(closed_at(F.col("day"), mark), "closed").otherwise("open").alias("kind"), "day", *TOTALS,
                               F.lit(None).cast("timestamp_ntz").alias("mark"))
            last = spark.range(1).select(F.lit("mark").alias("kind"), F.lit(mark).cast("timestamp_ntz").alias("mark"))
            days.unionByName(last, allowMissingColumns=True).write.mode("overwrite").parquet(f"{base}/ledger/batch={n}")
        finally:
            partials.unpersist()

    return each_batch


def watch_days(events: DataFrame, out_dir: str, checkpoint: str, lateness: _dt.timedelta = _dt.timedelta(days=1),
               interval: str | None = None) -> StreamingQuery:
    """Starts the stream over ``events`` (a streaming DataFrame with ts, event_type and value). Without an ``interval`` it
    takes what is there and ends; started again with the same folder and checkpoint, it goes on where it was."""
    w = events.writeStream.foreachBatch(_handler(out_dir, lateness)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def closed_days(spark: SparkSession, out_dir: str) -> DataFrame:
    """Totals of the closed days. A day has one row, which never changes again."""
    return _ledger(spark, out_dir).where("kind = 'closed'").select("day", *TOTALS, "batch")


def open_days(spark: SparkSession, out_dir: str) -> DataFrame:
    """Totals so far of the days that the newest batch left open."""
    led = _ledger(spark, out_dir)
    newest = led.agg(F.max("batch").alias("batch"))
    return led.where("kind = 'open'").join(newest, "batch").select("day", *TOTALS)


def late_rows(spark: SparkSession, out_dir: str, schema: str = EVENTS_SCHEMA) -> DataFrame:
    """Rows that came after their day was closed, and rows without a time, of batches that were finished."""
    done = _ledger(spark, out_dir).where("kind = 'mark'").select("batch")
    base = f"{out_dir.rstrip('/')}/late"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{schema}, day date, batch bigint")
    return spark.read.schema(f"{schema}, day date, batch bigint").parquet(base).join(done, "batch", "left_semi")
