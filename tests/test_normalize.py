"""Normalizer: golden mappings of FIXTURES.md section 3 on frames with the sample files' column names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adlens.operators.normalize import map_columns_catalog, match_column, normalize, plan_mapping
from adlens.operators.rowid import row_index
from adlens.sources.facts import table

D = dt.date(2024, 2, 1)


def marketing(spark):
    rows = [(D + dt.timedelta(days=i % 4), f"Camp_{i % 3}", 1000 + 10 * i, 30 + i, 2 + i % 3, 10 + i, 25 + i,
             "US", "Search") for i in range(12)]
    return spark.createDataFrame(rows, "report_date date, campaign string, impr int, clk int, conv int, "
                                       "media_cost int, total_revenue int, geo string, traffic_source string")


def ecommerce(spark):
    rows = [(f"2024-01-{1 + i:02d}", f"grp{i % 4}", 40000 + i, 1200 + i, 40 + i, 400 + i, 1500 + i, "DE", "Email")
            for i in range(12)]
    return spark.createDataFrame(rows, "timestamp string, ad_group string, views long, visits long, orders long, "
                                       "cost long, sales_value long, country string, channel string")


def analytics(spark):
    rows = [(f"2024-03-{1 + i:02d}", f"n{i % 5}", 100000 + i, 4000 + i, 120 + i, 1100 + i, 3800 + i, "EU", "cpc")
            for i in range(10)]
    return spark.createDataFrame(rows, "day string, name string, shows long, hits long, actions long, "
                                       "expense long, amount long, area string, medium string")


def test_match_column_examples():
    assert match_column("o_orderkey") == "conversions"        # unanchored 'order'
    assert match_column("Campaign_Name ") == "campaign_name"
    assert match_column("campaign_name", "wide") == "campaign_id"
    assert match_column("sales_value", "wide") == "conversions"
    assert match_column("nothing_here") is None


def test_marketing_lean_and_wide(spark):
    df = marketing(spark)
    out, rep = normalize(df, "lean")
    assert rep.mapping == {"report_date": "date", "campaign": "campaign_name", "impr": "impressions",
                           "clk": "clicks", "conv": "conversions", "media_cost": "spend",
                           "total_revenue": "revenue", "geo": "region", "traffic_source": "platform"}
    assert rep.synthetic == ["campaign_id"]
    assert sorted(int(r.campaign_id) for r in out.collect()) == list(range(1, 13))
    out_w, rep_w = normalize(df, "wide")
    assert rep_w.mapping["campaign"] == "campaign_id"
    assert "campaign_name" in rep_w.synthetic
    assert out_w.where(F.col("campaign_name") != F.col("campaign_id")).count() == 0


def test_ecommerce_text_dates_and_wide_adoption(spark):
    df = ecommerce(spark)
    out, rep = normalize(df, "lean")
    assert rep.mapping["timestamp"] == "date" and rep.mapping["sales_value"] == "revenue"
    assert dict(out.dtypes)["date"] == "date"
    assert rep.date_format == "yyyy-MM-dd"
    _, rep_w = normalize(df, "wide")
    assert rep_w.mapping["orders"] == "conversions"
    assert rep_w.mapping["sales_value"] == "revenue" and rep_w.how["sales_value"] in ("adopted", "type")


def test_analytics_lean(spark):
    out, rep = normalize(analytics(spark), "lean")
    assert rep.mapping == {"day": "date", "name": "campaign_name", "shows": "impressions", "hits": "clicks",
                           "actions": "conversions", "expense": "spend", "amount": "revenue", "area": "region",
                           "medium": "platform"}
    tot = out.agg(F.sum("impressions"), F.sum("revenue")).first()
    assert tot[0] == sum(100000 + i for i in range(10)) and tot[1] == sum(3800 + i for i in range(10))


def test_events_report(spark, sf_small):
    _, rep = normalize(table(spark, sf_small, "events"), "lean", order_by=["event_id"])
    assert rep.how == {"value": "pattern", "event_id": "type", "ts": "type", "user_id": "adopted"}
    assert set(rep.synthetic) == {"campaign_name", "campaign_id", "conversions", "spend", "region", "platform"}


def test_unparseable_date_stays_text(spark):
    df = spark.createDataFrame([("2024-01-01", 5), ("not a date", 6)], "date string, clicks int")
    out, rep = normalize(df, "lean", run_date="2024-01-01")
    assert dict(out.dtypes)["date"] == "string" and rep.date_format is None


def test_missing_date_uses_run_date(spark):
    df = spark.createDataFrame([(5,)], "clicks int")
    out, rep = normalize(df, "lean", run_date="2024-05-06")
    assert out.first().date == dt.date(2024, 5, 6) and "date" in rep.synthetic
    assert out.first().campaign_name == "Campaign_1"


def test_name_clash_raises(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-02", 1)], "created string, date string, clicks int")
    with pytest.raises(ValueError):
        normalize(df, "lean")
    out, rep = normalize(df, "lean", exact_first=True)
    assert rep.mapping["date"] == "date"


def test_custom_mapping_and_collision(spark):
    df = marketing(spark)
    _, rep = normalize(df, "lean", custom_mapping={"geo": "platform", "traffic_source": "region"})
    assert rep.mapping["geo"] == "platform" and rep.how["geo"] == "custom"
    with pytest.raises(ValueError):
        plan_mapping(df, "lean", custom_mapping={"geo": "clicks"})


def test_catalog_form_equals_planner(spark):
    frames = {"marketing": marketing(spark), "ecommerce": ecommerce(spark), "analytics": analytics(spark),
              "pagesish": spark.createDataFrame([], "page_id long, url string, html string")}
    rows = [(feed, i, c) for feed, f in frames.items() for i, c in enumerate(f.columns)]
    cat = spark.createDataFrame(rows, "feed string, ordinal int, column_name string")
    got = {(r.feed, r.column_name): r.field for r in map_columns_catalog(cat, "lean").collect()}
    for feed, f in frames.items():
        taken, want = set(), {}
        for c in f.columns:
            m = match_column(c, "lean")
            want[c] = m if m and m not in taken else None
            if m:
                taken.add(m)
        assert {c: got[(feed, c)] for c in f.columns} == want


def test_row_index_dense(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7919) % 1000)
    a = row_index(df, "rid")
    assert sorted(r.rid for r in a.collect()) == list(range(1, 1001))
    b = row_index(df, "rid", start=0, order_by=["k"]).collect()
    assert all(r.rid == r.k for r in b)


def test_row_index_keeps_all_rows_after_a_shuffle(spark):
    wide = spark.range(0, 50_000, 1, 8).select("id", (F.col("id") % 997).alias("k"), F.repeat(F.lit("x"), 200).alias("pad"))
    for df in (wide.repartition("k"), wide.groupBy("id").agg(F.max("pad").alias("pad"))):
        out = row_index(df, "rid").agg(F.count("rid").alias("n"), F.count_distinct("rid").alias("d"), F.max("rid").alias("m")).first()
        assert (out["n"], out["d"], out["m"]) == (50_000, 50_000, 50_000)


def test_catalog_of_awkward_objects(spark):
    from adlens.operators.normalize import discover_catalog
    rows = [("a", '{"x": 1, "Day": "d", "o": {"k": 1}}'), ("a", '{"x": 2.5}'), ("a", None), ("a", "no json"), ("a", "[1, 2]"), ("b", '{"x": 7, "n": null}'), (None, '{"x": "t"}')]
    got = {(r.feed, r.column_name): (r.ordinal, r.dtype, r.rows) for r in discover_catalog(spark.createDataFrame(rows, "f string, j string"), "f", "j").collect()}
    assert got == {("a", "Day"): (0, "STRING", 1), ("a", "o"): (1, "OBJECT<k: BIGINT>", 1), ("a", "x"): (2, "DOUBLE", 2),
                   ("b", "n"): (0, "VOID", 1), ("b", "x"): (1, "BIGINT", 1), (None, "x"): (0, "STRING", 1)}


def test_distinct_share_near_one_half_is_counted_exactly(spark):
    from pyspark.sql import functions as F

    from adlens.operators.normalize import infer_column_types
    for distinct, kind in ((5000, "categorical"), (5001, "categorical_high_cardinality")):
        df = spark.range(10_000).select(F.concat(F.lit("k"), F.least(F.col("id"), F.lit(distinct - 1)).cast("string")).alias("s"))
        assert infer_column_types(df).first()["wide_type"] == kind


def test_json_kind_is_told_by_the_first_character(spark, tmp_dir):
    import os

    from adlens.sources.readers import _json_is_array, read_any
    for name, text, want in (("a", "  \n\t [{\"x\": 1}]", True), ("l", "{\"x\": 1}\n{\"x\": 2}", False), ("e", "", False), ("b", "\ufeff\n" + " " * 9000 + "[{\"x\": 1}]", True)):
        p = f"{tmp_dir}/{name}.json"
        with open(p, "w") as f:
            f.write(text)
        assert _json_is_array(spark, p) == want
    assert not _json_is_array(spark, f"{tmp_dir}/absent.json")
    os.makedirs(f"{tmp_dir}/d.json")
    with open(f"{tmp_dir}/d.json/part.json", "w") as f:
        f.write("[{\"x\": 1}]")
    assert _json_is_array(spark, f"{tmp_dir}/d.json") and read_any(spark, f"{tmp_dir}/l.json").count() == 2
