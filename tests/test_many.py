"""Many files in one plan: equal to one by one, jobs independent of the files; malformed rows; one-commit reports."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adlens.operators import explain as X
from adlens.operators import grouped as G
from adlens.operators.features import flag_by_contamination, guard_ok, zsum_score
from adlens.operators.metrics import row_metrics
from adlens.operators.normalize import normalize
from adlens.operators.quantile import exact_quantile
from adlens.operators.rollups import campaign_summary, kpi_totals
from adlens.plans import many, publish
from adlens.sources import many as M
from adlens.sources.readers import read_any

FEATS = ["impressions", "clicks", "spend", "revenue"]


def write_csv(path, rows, header="Day,Campaign,Impr,Clicks,Conv,Cost,Revenue"):
    with open(path, "w") as f:
        f.write("\n".join([header, *rows]) + "\n")


def some_files(folder, n, rows=24, seed=1):
    os.makedirs(folder, exist_ok=True)
    import random
    r = random.Random(seed)
    for i in range(n):
        lines = [f"2025-11-{1 + j % 28:02d},c{j % 3},{r.randint(40_000, 90_000)},{r.randint(10, 900)},{r.randint(0, 9)},{r.randint(1, 500) / 4},{r.randint(1, 900) / 4}" for j in range(rows if i % 7 else 5)]
        if i % 7:
            lines[i % rows] = f"2025-11-30,c9,{i + 1},1,0,9999.5,0.25"
        write_csv(f"{folder}/f{i:03d}.csv", lines, "Day,Campaign,Impr,Clicks,Conv,Cost,Revenue" if i % 2 else "date,name,views,clk,orders,spend,sales")


def alone(spark, path):
    """The report of one file by the single-file operators."""
    norm, _ = normalize(read_any(spark, path), "lean")
    facts = row_metrics(norm, "guarded")
    if guard_ok(facts, FEATS):
        flagged = flag_by_contamination(zsum_score(facts, FEATS), 0.1)
    else:
        flagged = facts.withColumn("is_anomaly", F.lit(False))
    return facts, X.finding_text(X.explain_findings(flagged, FEATS))


def jobs_of(spark, work):
    group = f"count-{work.__name__}-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_files_equal_one_by_one(spark, tmp_dir):
    folder = f"{tmp_dir}/in"
    some_files(folder, 8)
    sections, bad, failed = many.reports_of_folder(spark, folder)
    kpis = {os.path.basename(r[many.KEY]): r for r in sections["kpis"].collect()}
    findings, campaigns = sections["findings"].collect(), sections["campaigns"].collect()
    ids = sorted((os.path.basename(r[0]), r[1]) for r in many.canonical_facts(M.read_layout(spark, M.layouts(spark, [f"{folder}/f001.csv"])[0][0])[0]).select(many.KEY, "campaign_id").collect())
    assert [i for _, i in ids] == sorted(str(i) for i in range(1, 25))
    assert len(kpis) == 8 and bad.count() == 0 and failed.count() == 0
    for name in sorted(kpis):
        facts, own = alone(spark, f"{folder}/{name}")
        one = kpi_totals(facts).first()
        assert all(kpis[name][c] == pytest.approx(one[c]) for c in ("impressions", "clicks", "conversions", "spend", "revenue", "roi", "ctr"))
        mine = sorted((r.campaign_name, r.metric, str(r.date), r.severity, r.description) for r in findings if r[many.KEY].endswith(name))
        assert mine == sorted((r.campaign_name, r.metric, str(r.date), r.severity, r.description) for r in own.collect())
        assert bool(mine) == (int(name[1:4]) % 7 != 0)
        c = sorted((r.place, r.campaign_name, r.ctr, r.roi) for r in campaigns if r[many.KEY].endswith(name))
        assert [x[1:] for x in c] == [(r.campaign_name, r.ctr, r.roi) for r in campaign_summary(facts).collect()]


def test_jobs_do_not_grow_with_the_files(spark, tmp_dir):
    few, lots = f"{tmp_dir}/few", f"{tmp_dir}/lots"
    some_files(few, 4)
    some_files(lots, 500, rows=12)
    done = {}

    def run_few():
        many.write_folder_reports(spark, few, f"{tmp_dir}/out-few")

    def run_lots():
        many.write_folder_reports(spark, lots, f"{tmp_dir}/out-lots")

    for name, work in (("few", run_few), ("lots", run_lots)):
        done[name] = jobs_of(spark, work)
    assert done["lots"] <= done["few"] * 1.5 + 10  # adaptive plans may add a job for a shuffle that became large
    out = spark.read.parquet(f"{tmp_dir}/out-lots/kpis")
    assert out.count() == 500 and out.where("report_id IS NULL").count() == 0


def test_one_bad_file_does_not_stop_the_rest(spark, tmp_dir):
    folder = f"{tmp_dir}/in"
    some_files(folder, 3)
    open(f"{folder}/empty.csv", "w").close()
    with open(f"{folder}/f001.csv", "a") as f:
        f.write("2025-11-30,only,three\n")
    for strict, n in ((True, 2), (False, 3)):
        sections, bad, failed = many.reports_of_folder(spark, folder, strict=strict)
        assert sections["kpis"].count() == n
        assert [(os.path.basename(r.path), r.row, r.reason) for r in bad.collect()] == [("f001.csv", "2025-11-30,only,three", "3 fields instead of 7")]
        assert sorted(os.path.basename(r.path) for r in failed.collect()) == ["empty.csv", "f001.csv"][: 2 if strict else 1]


def test_quarantine_reconciles(spark, tmp_dir):
    p = f"{tmp_dir}/q.csv"
    write_csv(p, ["1,a", "x,b", '2,"c,d"', "3", "4,e,f", '5,"g'], "n,t")
    good, bad = M.read_checked(spark, p, "csv", StructType.fromDDL("n int, t string"))
    assert sorted(r.n for r in good.collect()) == [1, 2, 5]
    assert sorted((r.row, r.reason) for r in bad.collect()) == [("3", "1 fields instead of 2"), ("4,e,f", "3 fields instead of 2"), ("x,b", "a value does not fit its column")]
    assert [(r.good, r.bad, r.rows) for r in M.reconcile(good, bad).collect()] == [(3, 3, 6)]
    M.release(good)
    p = f"{tmp_dir}/q.ndjson"
    with open(p, "w") as f:
        f.write('{"n": 1}\n{"n": "x"}\nnot json\n{"n": 4}\n')
    good, bad = M.read_checked(spark, p, "ndjson", StructType.fromDDL("n int"))
    assert sorted(r.n for r in good.collect()) == [1, 4]
    assert sorted((r.row, r.reason) for r in bad.collect()) == [("not json", "not a JSON object"), ('{"n": "x"}', "a value does not fit its column")]
    M.release(good)
    with pytest.raises(ValueError):
        M.read_checked(spark, p, "parquet")


def test_grouped_quantile_with_ties_a_hot_group_and_gaps(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("nan")).when(F.col("id") < 2000, 1.5).otherwise((F.col("id") * 7919 % 1000) / 8.0).alias("v"))
    for q in (0.0, 0.1, 0.5, 1.0):
        got = {r.k: r.quantile for r in G.grouped_quantile(df, "k", "v", q).collect()}
        assert got == {r.k: pytest.approx(exact_quantile(df.where(F.col("k") == r.k), "v", q)) for r in df.select("k").distinct().collect()}
    assert G.grouped_quantile(df.limit(0), "k", "v", 0.5).count() == 0


def test_a_report_becomes_visible_as_a_whole(spark, tmp_dir):
    df = spark.range(3)
    assert publish.published(spark, tmp_dir, "r") == {}
    publish.publish({"a": df, "b": df, "_x": df, "none": None}, tmp_dir, "r")

    class Broken:
        sparkSession, schema = spark, df.schema

        @property
        def write(self):
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish.publish({"a": df.where("id > 0"), "b": Broken()}, tmp_dir, "r")
    got = publish.published(spark, tmp_dir, "r")
    assert {n: x.count() for n, x in got.items()} == {"a": 3, "b": 3}
    m = publish.publish({"a": df.where("id > 0"), "b": df.where("id > 5")}, tmp_dir, "r")
    assert m["number"] == 1 and {n: x.count() for n, x in publish.published(spark, tmp_dir, "r").items()} == {"a": 2, "b": 0}
    assert len(publish.sweep(spark, tmp_dir, "r")) == 2 and publish.published(spark, tmp_dir, "r")["a"].count() == 2
    # two writers with the same number: the second takes the next
    assert not publish._commit(spark, _draft(spark, tmp_dir), f"{tmp_dir}/manifests/r/{1:012d}.json")


def _draft(spark, folder):
    os.makedirs(f"{folder}/manifests/r", exist_ok=True)
    with open(f"{folder}/manifests/r/x.draft", "w") as f:
        f.write("{}")
    return f"{folder}/manifests/r/x.draft"


def test_footers_answer_without_a_scan(spark, tmp_dir):
    import contextlib
    import io

    from adlens.sources.footers import footer_aggregate, footer_profile
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") * 0.5).alias("x"), F.col("id").cast("string").alias("s"),
                                  F.array("id").alias("a"), (F.col("id") > 3).alias("b"), F.lit(None).cast("int").alias("none"))
    df.repartition(3).write.parquet(f"{tmp_dir}/t")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        footer_aggregate(spark, f"{tmp_dir}/t").explain("formatted")
    assert "PushedAggregation: [COUNT(*)" in out.getvalue()
    got = {r.column_name: (r.row_count, r.null_count, r.min, r.max) for r in footer_profile(spark, f"{tmp_dir}/t").collect()}
    assert got == {"id": (1000, 0, "0", "999"), "x": (1000, 100, "0.5", "499.5"), "s": (1000, 0, None, None), "a": (1000, None, None, None),
                   "b": (1000, 0, "false", "true"), "none": (1000, 1000, None, None)}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    df.drop("none").write.parquet(f"{tmp_dir}/full")
    assert {r.column_name: (r.row_count, r.null_count, r.min, r.max) for r in footer_profile(spark, f"{tmp_dir}/full").collect()} == {k: v for k, v in got.items() if k != "none"}
    assert footer_aggregate(spark, f"{tmp_dir}/full").first() == footer_aggregate(spark, f"{tmp_dir}/full", scan=True).first()
