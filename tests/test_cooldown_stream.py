"""Streaming cooldown over time-ordered files equals the batch operator on the whole table."""

import pyarrow.parquet as pq

from adlens.operators.cooldown import cooldown_keep
from adlens.streaming.cooldown_stream import cooldown_stream, keep_after
from adlens.streaming.daily import EVENTS_SCHEMA

import numpy as np


def test_keep_after():
    t = np.array([0, 1, 5, 6, 10, 20])
    idx, last = keep_after(t, None, 5)
    assert idx.tolist() == [0, 2, 4, 5] and last == 20
    idx, last = keep_after(t, 3, 5)
    assert idx.tolist() == [4, 5]


def test_stream_equals_batch(spark, sf_small, tmp_dir):
    ev = pq.read_table(f"{sf_small}/events.parquet").sort_by("ts")
    n = ev.num_rows
    src = f"{tmp_dir}/events_in"
    import os
    os.makedirs(src)
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(ev.slice(a, b - a), f"{src}/part{i}.parquet")
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (cooldown_stream(stream, "user_id", "ts", 6 * 3600, "event_id").writeStream
         .format("parquet").option("path", f"{tmp_dir}/kept").option("checkpointLocation", f"{tmp_dir}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/kept").collect())
    whole = spark.read.parquet(f"{sf_small}/events.parquet")
    want = sorted(r.event_id for r in cooldown_keep(whole, "user_id", "ts", 6 * 3600, "event_id").collect())
    assert got == want and len(got) > 0
