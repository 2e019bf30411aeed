"""Readers: format dispatch, JSON array vs lines, SQLite partitions, errors, folder backlog."""

import datetime as dt
import json
import os
import sqlite3

import pytest

from adlens.operators.normalize import normalize
from adlens.sources.readers import list_folder, load_metadata, read_any, read_folder

HEADER = "date,campaign_id,campaign_name,impressions,clicks,conversions,spend,revenue,region,platform"
ROWS = [f"2025-11-{1 + i:02d},C{i % 3},Camp_{i % 3},{10000 + i},{300 + i},{10 + i},{100.5 + i},{250.25 + i},R{i % 2},P{i % 4}"
        for i in range(14)]


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def records():
    out = []
    for r in ROWS:
        v = r.split(",")
        out.append({"timestamp": v[0], "ad_group": v[2], "views": int(v[3]), "visits": int(v[4]),
                    "orders": int(v[5]), "cost": float(v[6]), "sales_value": float(v[7]),
                    "country": v[8], "channel": v[9]})
    return out


def test_csv_types_and_totals(spark, tmp_dir):
    p = write(f"{tmp_dir}/ad.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    df = read_any(spark, p)
    assert dict(df.dtypes)["date"] == "date" and dict(df.dtypes)["impressions"] == "int"
    assert df.count() == 14
    meta = load_metadata(df, p, "csv")
    assert meta["rows"] == 14 and meta["columns"] == 10
    fixed = read_any(spark, p, schema=", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in HEADER.split(",")))
    assert dict(fixed.dtypes)["impressions"] == "string"  # an explicit schema skips inference


def test_json_array_and_lines(spark, tmp_dir):
    recs = records()
    a = write(f"{tmp_dir}/arr.json", json.dumps(recs, indent=2))
    b = write(f"{tmp_dir}/lines.json", "\n".join(json.dumps(r) for r in recs))
    c = write(f"{tmp_dir}/lines.ndjson", "\n".join(json.dumps(r) for r in recs))
    for p in (a, b, c):
        df = read_any(spark, p)
        assert df.count() == 14, p
        out, rep = normalize(df, "lean")
        assert rep.mapping["views"] == "impressions"
        assert out.agg({"impressions": "sum"}).first()[0] == sum(r["views"] for r in recs)


def test_sqlite_first_table_and_partitions(spark, tmp_dir):
    p = f"{tmp_dir}/campaign_db.sqlite"
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE campaigns (date TEXT, campaign_name TEXT, impressions INTEGER, spend REAL)")
    con.executemany("INSERT INTO campaigns VALUES (?,?,?,?)",
                    [(str(dt.date(2024, 1, 1) + dt.timedelta(days=i % 60)), f"c{i % 3}", 1000 + i, 1.5 * i)
                     for i in range(1000)])
    con.execute("CREATE TABLE other (x INTEGER)")
    con.commit()
    con.close()
    df = read_any(spark, p, partitions="4")
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 1000 and dict(df.dtypes)["impressions"] == "bigint"
    assert df.agg({"impressions": "sum"}).first()[0] == sum(1000 + i for i in range(1000))
    out, rep = normalize(df, "lean")
    assert dict(out.dtypes)["date"] == "date"
    assert read_any(spark, p, table="campaigns", fmt="db").count() == 1000


def test_errors(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        read_any(spark, f"{tmp_dir}/missing.csv")
    with pytest.raises(ValueError):
        read_any(spark, write(f"{tmp_dir}/x.txt", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        read_any(spark, write(f"{tmp_dir}/empty.csv", ""))
    with pytest.raises(ValueError):
        read_any(spark, write(f"{tmp_dir}/y.ndjson", "{}"), profile="wide")


def test_folder_backlog_isolates_failures(spark, tmp_dir):
    d = f"{tmp_dir}/inbox"
    os.makedirs(d)
    write(f"{d}/good.csv", HEADER + "\n" + "\n".join(ROWS) + "\n")
    write(f"{d}/good.json", json.dumps(records()))
    write(f"{d}/bad.parquet", "not parquet")
    write(f"{d}/notes.txt", "ignored")
    os.makedirs(f"{d}/sub")
    write(f"{d}/sub/deep.csv", HEADER + "\n")
    assert [os.path.basename(p) for p in list_folder(spark, d)] == ["bad.parquet", "good.csv", "good.json"]
    res = {os.path.basename(p): (df, err) for p, df, err in read_folder(spark, d)}
    assert res["good.csv"][0].count() == 14 and res["good.json"][0].count() == 14
    assert res["bad.parquet"][0] is None and res["bad.parquet"][1]


def test_load_and_normalize_and_conditional_metrics(spark, tmp_dir):
    from adlens.operators.metrics import row_metrics
    from adlens.plans.pipeline import load_and_normalize
    recs = records()
    p = write(f"{tmp_dir}/feed.ndjson", "\n".join(json.dumps(r) for r in recs))
    df, rep = load_and_normalize(spark, p, custom_mapping={"country": "platform", "channel": "region"})
    assert rep.how["country"] == "custom" and df.first().platform == "R0"
    # A metric is added only when its inputs exist
    part = spark.createDataFrame([(100, 5)], "impressions long, clicks long")
    assert set(row_metrics(part).columns) == {"impressions", "clicks", "ctr"}


def test_malformed_csv_rows_are_errors(spark, tmp_dir):
    for i, bad in enumerate((ROWS[0].rsplit(",", 5)[0], ROWS[0] + ",x,y")):
        p = write(f"{tmp_dir}/bad{i}.csv", HEADER + "\n" + "\n".join([*ROWS, bad]) + "\n")
        with pytest.raises(Exception):  # noqa: B017 - Spark raises when the rows are read
            read_any(spark, p).collect()


def test_json_is_told_apart_in_folders_and_globs(spark, tmp_dir):
    import os
    for part in ("part=0", "part=1"):
        for form, text in (("arrays", '[{"x": 1}, {"x": 2}]'), ("lines", '{"x": 1}\n{"x": 2}\n')):
            os.makedirs(f"{tmp_dir}/{form}/{part}")
            write(f"{tmp_dir}/{form}/{part}/_hidden", "[")
            write(f"{tmp_dir}/{form}/{part}/a.json", text)
    for form in ("arrays", "lines"):
        assert read_any(spark, f"{tmp_dir}/{form}/part=*", fmt="json").count() == 4
        assert sorted(r.part for r in read_any(spark, f"{tmp_dir}/{form}", fmt="json").collect()) == [0, 0, 1, 1]
