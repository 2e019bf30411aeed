"""Dates by shape: equal to the parser for every text, without calling it for text of another shape."""

import random

from pyspark.sql import functions as F

from adlens.operators.normalize import DATE_FORMATS, date_of, normalize


def texts():
    r = random.Random(5)
    some = ["", " ", "2024-01-05", "2024-02-30", "2023-02-29", "2024-02-29", "0000-01-01", "0001-12-31", "9999-12-31", "-2024-01-05", "+2024-01-05", "+12024-01-05", "12024-01-05",
            "-0044-03-15", "2024-1-5", "2024-01-05 ", " 2024-01-05", "2024-01-05\n", "2024-01-0\n", "2024-01-05T00:00:00", "2024-13-01", "2024-00-10", "2024-01-00", "05-01-2024", "05-01--2024",
            "05-01-+12024", "05/01/2024", "31/04/2024", "05.01.2024", "2024.01.05", "2024/01/05", "2024-01/05", "05-01/2024", "٢٠٢٤-٠١-٠٥", "2024a01b05", "20240105", "today", "epoch",
            "05-01-12345678901234567890", "+290000-01-11", "05.01.+290000"]
    for _ in range(3000):
        y, m, d, s, t = r.choice([r.randint(0, 9999), r.randint(1900, 2100)]), r.randint(0, 13), r.randint(0, 32), r.choice("-/."), r.choice("-/.")
        x = f"{y:04d}{s}{m:02d}{t if r.random() < 0.1 else s}{d:02d}" if r.random() < 0.5 else f"{d:02d}{s}{m:02d}{t if r.random() < 0.1 else s}{y:04d}"
        if r.random() < 0.3:
            at = r.randrange(len(x))
            x = x[:at] + r.choice("0123456789-/.+ x") * r.randint(0, 2) + x[at + r.randint(0, 1):]
        some.append(x)
    return [*some, None]


def test_shapes_equal_the_parser(spark):
    df = spark.createDataFrame([(x,) for x in texts()], "x string").repartition(2)
    wrong = df.select("x", *[F.struct(date_of("x", f).alias("a"), F.try_to_date("x", f).alias("b")).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)])
    for i, f in enumerate(DATE_FORMATS):
        assert [tuple(r) for r in wrong.where(~F.col(f"f{i}.a").eqNullSafe(F.col(f"f{i}.b"))).select("x", f"f{i}").collect()] == [], f
        assert wrong.where(F.col(f"f{i}.a").isNotNull()).count() > 200


def test_other_shapes_do_not_reach_the_parser(spark):
    # one text in each format, and a column that mixes two of them
    day = F.expr("date_add(date'2024-01-01', cast(id % 300 as int))")
    for fmt in DATE_FORMATS:
        got, rep = normalize(spark.range(900).select(F.date_format(day, fmt).alias("day"), F.lit("1").alias("campaign_id"), F.col("id").alias("impressions")), "lean")
        assert rep.date_format == fmt and dict(got.dtypes)["date"] == "date" and got.select("date").distinct().count() == 300
    mixed = F.when(F.col("id") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    got, rep = normalize(spark.range(900).select(mixed.alias("day"), F.lit("1").alias("campaign_id"), F.col("id").alias("impressions")), "lean")
    assert rep.date_format is None and dict(got.dtypes)["date"] == "string"
    # a failing parse raises in the parser; many of them took most of the time of a column in another format
    import time
    slow = spark.range(300_000).select(F.date_format(day, "dd.MM.yyyy").alias("x"))
    took = {}
    for name, tried in (("parser", [F.try_to_date("x", f) for f in DATE_FORMATS]), ("shape", [date_of("x", f) for f in DATE_FORMATS])):
        run = lambda: slow.agg(*[F.count_if(t.isNull()) for t in tried]).collect()  # noqa: E731, B023
        run()
        began = time.time()
        assert [*run()[0]] == [300_000] * 5 + [0]
        took[name] = time.time() - began
    assert took["shape"] < took["parser"]
