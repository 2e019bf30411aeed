"""W4 cooldown: distributed pointer doubling equals the row-by-row rule, with a hot key and equal times."""

import datetime as dt

import numpy as np
import pandas as pd

from adlens.operators.cooldown import cooldown_keep


def cooldown_keep_small(pdf: pd.DataFrame, key: str, ts: str, seconds: float, id_col: str) -> pd.DataFrame:
    """The rule applied row by row."""
    out, last = [], {}
    for _, row in pdf.sort_values([key, ts, id_col]).iterrows():
        k, t = row[key], pd.Timestamp(row[ts])
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            last[k] = t
            out.append(row)
    return pd.DataFrame(out, columns=pdf.columns)


def test_matches_sequential_rule_with_hot_key(spark):
    rng = np.random.default_rng(3)
    n = 3000
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))      # key 0 holds about a third
    base = dt.datetime(2024, 1, 1)
    secs = rng.integers(0, 86400 * 3, n) // 30 * 30                          # many equal times
    pdf = pd.DataFrame({"id": np.arange(n), "key": keys,
                        "ts": [base + dt.timedelta(seconds=int(s)) for s in secs]})
    df = spark.createDataFrame(pdf).repartition(7)
    for seconds in (0.0, 60.0, 3600.0):
        got = sorted(r.id for r in cooldown_keep(df, "key", "ts", seconds, "id").collect())
        want = sorted(cooldown_keep_small(pdf, "key", "ts", seconds, "id")["id"].tolist())
        assert got == want, seconds


def test_single_event_and_empty(spark):
    df = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 1))], "id long, key long, ts timestamp")
    assert cooldown_keep(df, "key", "ts", 5, "id").count() == 1
