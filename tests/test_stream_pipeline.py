"""Pipeline end to end and the folder watcher (W1-W7) on temp folders."""

import json
import os

from pyspark.sql import functions as F

from adlens.plans.pipeline import process_file, report_id_of, write_report
from adlens.streaming.folder import process_existing, read_log, retry_failed, watch_folder
from test_sources import HEADER, ROWS, records, write


def test_process_file_writes_sections(spark, tmp_dir):
    p = write(f"{tmp_dir}/ad_report_q3.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    res = process_file(spark, p, f"{tmp_dir}/out", method="zsum", run_ts="r1")
    rid = res["report_id"]
    assert rid.startswith("ad_report_q3-") and rid == report_id_of(p)
    for s in ("kpis", "kpi_cards", "daily", "campaigns", "summary", "chart_series", "mapping"):
        assert os.path.isdir(f"{tmp_dir}/out/{s}/report_id={rid}/run_ts=r1"), s
    assert os.path.isdir(f"{tmp_dir}/out/findings")  # empty sections write a table without partitions
    k = spark.read.parquet(f"{tmp_dir}/out/kpis").first()
    assert k.impressions == sum(10000 + i for i in range(14))
    t = spark.read.parquet(f"{tmp_dir}/out/title").first().title
    assert t == "Ad Report Q3"


def test_watcher_isolates_errors_and_does_not_repeat(spark, tmp_dir):
    inbox, out, ckpt = f"{tmp_dir}/inbox", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    os.makedirs(inbox)
    write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    write(f"{inbox}/b.json", json.dumps(records()))
    write(f"{inbox}/c.parquet", "broken")
    write(f"{inbox}/d.txt", "ignored")
    q = watch_folder(spark, inbox, out, ckpt, method="zsum")
    q.awaitTermination(300)
    log = {os.path.basename(r.path): r for r in read_log(spark, out).collect()}
    assert set(log) == {"a.csv", "b.json", "c.parquet"}
    assert log["a.csv"].status == "ok" and log["b.json"].status == "ok" and log["c.parquet"].status == "error"
    # overwrite a processed file, add a new one, restart from the checkpoint
    write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS[:3]) + "\n")
    write(f"{inbox}/e.csv", HEADER + "\n" + "\n".join(ROWS[:5]) + "\n")
    q2 = watch_folder(spark, inbox, out, ckpt, method="zsum")
    q2.awaitTermination(300)
    n = read_log(spark, out).groupBy("path").count().where("count > 1").count()
    assert n == 0
    assert read_log(spark, out).where(F.col("path").endswith("e.csv")).count() == 1
    # the failed file is retried in batch once repaired
    spark.createDataFrame([r for r in spark.read.csv(f"{inbox}/e.csv", header=True).collect()]) \
        .write.mode("overwrite").parquet(f"{tmp_dir}/fixed")
    assert retry_failed(spark, out, method="zsum")[0][1] == "error"


def test_process_existing_backlog(spark, tmp_dir):
    inbox = f"{tmp_dir}/inbox2"
    os.makedirs(inbox)
    write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    write(f"{inbox}/z.parquet", "broken")
    res = {os.path.basename(p): s for p, s, _ in process_existing(spark, inbox, f"{tmp_dir}/o2", method="zsum")}
    assert res == {"a.csv": "ok", "z.parquet": "error"}


def test_rerun_of_a_batch_is_idempotent(spark, tmp_dir):
    from adlens.streaming.folder import _handler
    inbox, out = f"{tmp_dir}/inbox3", f"{tmp_dir}/out3"
    os.makedirs(inbox)
    p = write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    batch = spark.createDataFrame([("file:" + p, os.path.getsize(p))], "path string, length long").withColumn(
        "modificationTime", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    h = _handler(out, "lean", method="zsum")
    h(batch, 7)
    h(batch, 7)  # the same batch executed again after a failure
    assert read_log(spark, out).count() == 1
    assert spark.read.parquet(f"{out}/kpis").count() == 1


def test_files_of_one_stem_keep_their_own_reports(spark, tmp_dir):
    inbox, out = f"{tmp_dir}/inbox4", f"{tmp_dir}/out4"
    os.makedirs(inbox)
    write(f"{inbox}/a.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    write(f"{inbox}/a.json", json.dumps(records()))
    watch_folder(spark, inbox, out, f"{tmp_dir}/ckpt4", method="zsum").awaitTermination(300)
    assert read_log(spark, out).where("status = 'ok'").count() == 2
    assert spark.read.parquet(f"{out}/kpis").count() == 2


def test_section_that_becomes_empty_loses_its_old_rows(spark, tmp_dir):
    df = spark.createDataFrame([(1,)], "x int")
    write_report({"s": df, "t": df}, tmp_dir + "/r", "id", "r1")
    write_report({"s": df.where("x > 1"), "t": df}, tmp_dir + "/r", "id", "r1")
    assert spark.read.schema("x int, report_id string, run_ts string").parquet(tmp_dir + "/r/s").count() == 0
    assert spark.read.parquet(tmp_dir + "/r/t").count() == 1


def test_wide_profile_forest_pipeline(spark, tmp_dir):
    from adlens.plans.pipeline import analyze, release
    from adlens.sources.readers import read_any
    rows = [HEADER] + [r for r in ROWS for _ in range(5)]
    p = write(f"{tmp_dir}/wide.csv", "\n".join(rows) + "\n")
    t = analyze(read_any(spark, p, profile="wide"), profile="wide", method="iforest", n_trees=20)
    try:
        assert t["_cached"][0].count() == 70                 # scores persisted once
        flagged = t["alerts"].count()                         # one alert per flagged row
        assert 0 < flagged <= 8
        assert t["kpis"].first().impressions == 5 * sum(10000 + i for i in range(14))
        assert t["findings_summary"].where("dimension = 'total'").count() == 1
    finally:
        release(t)


def test_process_file_commits_all_sections_at_once(spark, tmp_dir):
    from adlens.plans.publish import published
    p = f"{tmp_dir}/one.csv"
    with open(p, "w") as f:
        f.write("date,campaign,impressions,clicks,conversions,cost,revenue\n" + "".join(f"2025-11-{i + 1:02d},c{i % 2},{1000 + i},{10 + i},1,{5.5 + i},{9.25 * i}\n" for i in range(12)))
    res = process_file(spark, p, f"{tmp_dir}/out", method="zsum", atomic=True)
    got = published(spark, f"{tmp_dir}/out", res["report_id"])
    assert set(got) == set(res["sections"]) >= {"kpis", "findings", "summary"} and got["kpis"].count() == 1 and got["daily"].count() == 12
