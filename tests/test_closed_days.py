"""Closed days and late rows: every event is in one place, and a day that came out never changes."""

import datetime as dt
import os

from pyspark.sql import functions as F

from adlens.streaming.closed_days import _handler, closed_days, late_rows, open_days, watch_days
from adlens.streaming.daily import EVENTS_SCHEMA


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def events(spark, rows):
    return spark.createDataFrame([(i, t, 1, kind, v, None) for i, t, kind, v in rows], EVENTS_SCHEMA)


def totals(df):
    return {r.day.day: (r.events, r.value_sum) for r in df.collect()}


def test_days_close_once_and_late_rows_are_kept(spark, tmp_dir):
    step = _handler(f"{tmp_dir}/o", dt.timedelta(days=1))
    step(events(spark, [(1, at(1), "view", 1.0), (2, at(2), "click", 2.0)]), 0)
    assert totals(closed_days(spark, f"{tmp_dir}/o")) == {} and set(totals(open_days(spark, f"{tmp_dir}/o"))) == {1, 2}
    # day 1 is still open when its second row comes; then the mark (day 3, midnight) closes days 1 and 2
    step(events(spark, [(3, at(1, 1), "view", 4.0), (4, at(4, 0), "view", None)]), 1)
    first = totals(closed_days(spark, f"{tmp_dir}/o"))
    assert first == {1: (2, 5.0), 2: (1, 2.0)} and totals(open_days(spark, f"{tmp_dir}/o")) == {4: (1, None)}
    # rows of closed days and rows without a time are late; the mark does not go back
    step(events(spark, [(5, at(2, 23), "view", 8.0), (6, None, "view", 1.0), (7, at(3), "view", 16.0)]), 2)
    assert totals(closed_days(spark, f"{tmp_dir}/o")) == first
    assert sorted((r.event_id, r.batch) for r in late_rows(spark, f"{tmp_dir}/o").collect()) == [(5, 2), (6, 2)]
    assert set(totals(open_days(spark, f"{tmp_dir}/o"))) == {3, 4}
    # an empty batch keeps the state, and a batch with late rows only keeps the mark
    step(events(spark, []), 3)
    step(events(spark, [(8, at(1), "view", 1.0)]), 4)
    assert set(totals(open_days(spark, f"{tmp_dir}/o"))) == {3, 4} and late_rows(spark, f"{tmp_dir}/o").count() == 3


def test_a_batch_run_again_replaces_its_output(spark, tmp_dir):
    step = _handler(f"{tmp_dir}/o", dt.timedelta(days=1))
    step(events(spark, [(1, at(1), "view", 1.0), (2, at(9), "click", 2.0)]), 0)
    again = events(spark, [(3, at(1), "view", 1.0), (4, at(9), "view", 3.0)])
    step(again, 1)
    step(again, 1)
    assert totals(closed_days(spark, f"{tmp_dir}/o")) == {1: (1, 1.0)}
    assert totals(open_days(spark, f"{tmp_dir}/o")) == {9: (2, 5.0)} and late_rows(spark, f"{tmp_dir}/o").count() == 1


def test_rows_of_an_unfinished_batch_are_not_read(spark, tmp_dir):
    step = _handler(f"{tmp_dir}/o", dt.timedelta(days=1))
    step(events(spark, [(1, at(9), "view", 1.0)]), 0)
    # late rows written, ledger not: the writer died between the two
    events(spark, [(2, at(1), "view", 1.0)]).withColumn("day", F.col("ts").cast("date")).write.parquet(f"{tmp_dir}/o/late/batch=1")
    assert late_rows(spark, f"{tmp_dir}/o").count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, tmp_dir):
    inbox = f"{tmp_dir}/in"
    os.makedirs(inbox)
    run = lambda: watch_days(spark.readStream.schema(EVENTS_SCHEMA).parquet(inbox), f"{tmp_dir}/o", f"{tmp_dir}/c").awaitTermination(120)
    events(spark, [(1, at(1), "view", 1.0), (2, at(5), "view", 1.0)]).write.mode("append").parquet(inbox)
    run()
    events(spark, [(3, at(1), "view", 1.0), (4, at(5), "view", 1.0)]).write.mode("append").parquet(inbox)
    run()
    assert totals(closed_days(spark, f"{tmp_dir}/o")) == {1: (1, 1.0)}
    assert totals(open_days(spark, f"{tmp_dir}/o")) == {5: (2, 2.0)}
    assert [r.event_id for r in late_rows(spark, f"{tmp_dir}/o").collect()] == [3]
