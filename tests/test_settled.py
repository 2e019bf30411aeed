"""W3 by state: a file that grows is taken once, after it stands still, also over a restart."""

import datetime as dt
import os
import time

from adlens.streaming.folder import read_log
from adlens.streaming.settled import tick_handler, watch_settled
from test_sources import HEADER, ROWS, write

T0 = dt.datetime(2024, 1, 1)


def clock(spark, second):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=second), 0)] if second is not None else [], "timestamp timestamp, value long")


def watcher(inbox, ledger, **kw):
    got = []
    step = tick_handler(inbox, ledger, lambda df, n: got.extend((os.path.basename(r.path), n) for r in df.orderBy("path").collect()), 2.0, **kw)
    return step, got


def test_growing_file_is_taken_once_after_it_settles(spark, tmp_dir):
    inbox, ledger = f"{tmp_dir}/in", f"{tmp_dir}/led"
    os.makedirs(inbox)
    step, got = watcher(inbox, ledger)
    step(clock(spark, 0), 0)                                # an empty folder
    write(f"{inbox}/a.csv", "x\n1\n")
    write(f"{inbox}/skip.txt", "x")
    step(clock(spark, 1), 1)
    write(f"{inbox}/a.csv", "x\n1\n2\n")                    # still growing
    step(clock(spark, 3), 2)
    step(clock(spark, None), 3)                             # a batch without a tick
    step(clock(spark, 4), 4)
    assert got == []
    again, later = watcher(inbox, ledger)                   # the watcher starts anew: the wait is in the ledger
    again(clock(spark, 5), 5)
    assert later == [("a.csv", 5)]
    write(f"{inbox}/a.csv", "x\n9\n")                       # overwritten after it was taken
    again(clock(spark, 6), 6)
    again(clock(spark, 9), 7)
    assert later == [("a.csv", 5)]
    assert sorted(n for n in os.listdir(ledger) if n.startswith("tick=")) == ["tick=6", "tick=7"]


def test_a_tick_run_again_takes_its_files_again(spark, tmp_dir):
    inbox = f"{tmp_dir}/in"
    os.makedirs(inbox)
    write(f"{inbox}/a.csv", "x\n1\n")
    step, got = watcher(inbox, f"{tmp_dir}/led")
    step(clock(spark, 0), 0)
    step(clock(spark, 2), 1)
    step(clock(spark, 2), 1)                                # the writer died after the ledger
    step(clock(spark, 4), 2)
    assert got == [("a.csv", 1), ("a.csv", 1)]


def test_files_beyond_a_ticks_bound_wait_for_the_next(spark, tmp_dir):
    inbox = f"{tmp_dir}/in"
    os.makedirs(inbox)
    for n in "cab":
        write(f"{inbox}/{n}.csv", "x\n1\n")
    step, got = watcher(inbox, f"{tmp_dir}/led", max_files=2)
    for n in range(4):
        step(clock(spark, 2 * n), n)
    assert got == [("a.csv", 1), ("b.csv", 1), ("c.csv", 2)]


def test_file_that_goes_and_comes_back_is_a_new_one(spark, tmp_dir):
    inbox = f"{tmp_dir}/in"
    os.makedirs(inbox)
    p = write(f"{inbox}/a.csv", "x\n1\n")
    step, got = watcher(inbox, f"{tmp_dir}/led")
    step(clock(spark, 0), 0)
    step(clock(spark, 2), 1)
    os.remove(p)
    step(clock(spark, 4), 2)
    write(f"{inbox}/a.csv", "x\n1\n")
    step(clock(spark, 6), 3)
    step(clock(spark, 8), 4)
    assert got == [("a.csv", 1), ("a.csv", 4)]


def test_stream_reports_a_settled_file_over_a_restart(spark, tmp_dir):
    inbox, out, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    start = lambda: watch_settled(spark, inbox, out, ckpt, settle_seconds=1.0, method="zsum")
    q = start()
    write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    write(f"{inbox}/bad.parquet", "broken")

    def wait_for(n, seconds=90):
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            assert q.exception() is None
            if os.path.isdir(f"{out}/_log") and any(d.startswith("batch=") for d in os.listdir(f"{out}/_log")) and read_log(spark, out).count() >= n:
                return
            time.sleep(1)
        raise AssertionError("not taken in time")

    try:
        wait_for(2)
        q.stop()
        write(f"{inbox}/b.csv", HEADER + "\n" + "\n".join(ROWS[:12]) + "\n")
        q = start()
        wait_for(3)
    finally:
        q.stop()
    log = {os.path.basename(r.path): r.status for r in read_log(spark, out).collect()}
    assert log == {"a.csv": "ok", "b.csv": "ok", "bad.parquet": "error"}
    assert read_log(spark, out).count() == 3 and spark.read.parquet(f"{out}/kpis").count() == 2
