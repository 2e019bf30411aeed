"""W4 on event tables: per key, keep an event if it comes at least ``d`` after the last *kept* one.

The rule is sequential (whether an event is kept depends on the last kept
one), and one key may hold a large share of all rows, so the whole key is
never put into one group. Instead:

1. ``next``: for every event, the first event of the same key at or after
   ``ts + d``. Events and one probe row per event (at ``ts + d``) are sorted
   together by (key, time, kind, id) with Spark's range-partitioned sort, so a
   hot key spreads over many partitions. A running count of events in that
   order gives each event its index and each probe the index of the event
   right after it; only one count per partition reaches the driver.
2. Pointer doubling: ``J0 = next``, ``J(k+1)(i) = Jk(Jk(i))``, until no chain is
   longer than ``2^k``. Each round is one join on the event index (AQE splits a
   target many events point to) and is checkpointed to the shared folder.
3. The kept events are the chain from each key's first event: starting from
   the first events, for k from high to low, add ``Jk`` of the current set.
   Every chain position is reached exactly once (its binary expansion).

Work is O(n log L) for the longest chain L; no pairs within a key are formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from adlens.session import ensure_checkpoint_dir

_MICROS = 1_000_000


def _ranked(merged: DataFrame) -> DataFrame:
    """Add ``before``: number of event rows (kind = 1) before each row in global (k, t, kind, id) order."""
    srt = merged.orderBy("k", "t", "kind", "id").withColumn("pid", F.spark_partition_id()).checkpoint(eager=True)
    totals = sorted(srt.groupBy("pid").agg(F.sum("kind").alias("n")).collect())
    offs, run = [], 0
    for r in totals:
        offs.append((int(r["pid"]), run))
        run += int(r["n"] or 0)
    off = merged.sparkSession.createDataFrame(offs, "pid int, off long")

    def local_prefix(batches):
        seen = 0
        for pdf in batches:
            kind = pdf["kind"].to_numpy(dtype=np.int64)
            pdf["local"] = seen + np.cumsum(kind) - kind
            seen += int(kind.sum())
            yield pdf

    schema = StructType([*srt.schema.fields, StructField("local", LongType())])
    loc = srt.mapInPandas(local_prefix, schema)
    return loc.join(F.broadcast(off), "pid").withColumn("before", F.col("local") + F.col("off")).drop(
        "local", "off", "pid")


def cooldown_keep(df: DataFrame, key: str, ts: str, seconds: float, id_col: str) -> DataFrame:
    """Rows of ``df`` kept by the per-key cooldown; ``id_col`` must be unique (tie-break at equal time)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = int(round(seconds * _MICROS))
    if d <= 0:
        return df  # every event is at least 0 after the last kept one
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    ev = df.select(F.col(key).alias("k"), t.alias("t"), F.col(id_col).alias("id"))
    merged = ev.withColumn("kind", F.lit(1)).unionByName(
        ev.withColumn("t", F.col("t") + F.lit(d)).withColumn("kind", F.lit(0)))
    r = _ranked(merged).checkpoint(eager=True)
    events = r.where("kind = 1").select("k", "id", F.col("before").alias("idx"))
    probes = r.where("kind = 0").select("id", F.col("before").alias("cand"))
    owner = events.select(F.col("idx").alias("cand"), F.col("k").alias("ck"))
    j = (
        events.join(probes, "id").join(owner, "cand").where(F.col("ck") == F.col("k"))
        .select("idx", F.col("cand").alias("nxt"))
        .checkpoint(eager=True)
    )
    jumps = [j]
    while not jumps[-1].isEmpty():  # finished chains have no row, so no null key gathers them
        if len(jumps) > 64:  # next always points forward, so 2^64 covers any table
            raise RuntimeError("pointer doubling did not converge")
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        nj = a.join(b, F.col("a.nxt") == F.col("b.idx")).select(
            F.col("a.idx").alias("idx"), F.col("b.nxt").alias("nxt")).checkpoint(eager=True)
        jumps.append(nj)
    # jumps[-1] is empty: the chains are shorter than 2^(len-1)
    chain = events.groupBy("k").agg(F.min("idx").alias("idx")).select("idx").checkpoint(eager=True)
    for jk in reversed(jumps[:-1]):
        step = chain.join(jk, "idx").select(F.col("nxt").alias("idx"))
        chain = chain.unionByName(step).checkpoint(eager=True)
    kept_ids = events.join(chain, "idx", "left_semi").select(F.col("id").alias("__kid"))
    return df.join(kept_ids, F.col(id_col) == F.col("__kid"), "left_semi")
