"""W4 on a stream: per key, keep an event that comes ``d`` or more after the last kept one.

State per key is one value (the last kept time, in microseconds), so state
size is set by the number of keys. Each micro-batch sorts the key's new rows by
(time, id) and walks them with ``searchsorted`` jumps: the loop runs once per
kept event. A key's rows in one micro-batch are bounded by the trigger size
(``maxFilesPerTrigger`` / ``maxBytesPerTrigger``). Rows that arrive later than
the last kept event of their key are dropped, as files arriving after a
processing are in the reference's watcher (processing order, not event time).
The batch form over a whole table is ``adlens.operators.cooldown``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_after(t: np.ndarray, last: int | None, d: int) -> tuple[np.ndarray, int | None]:
    """Indices of kept times in sorted ``t`` given the last kept time; returns (indices, new last)."""
    out = []
    i = 0 if last is None else int(np.searchsorted(t, last + d, side="left"))
    while i < len(t):
        out.append(i)
        last = int(t[i])
        i = int(np.searchsorted(t, last + d, side="left"))
    return np.asarray(out, dtype=np.int64), last


class _Cooldown(StatefulProcessor):
    def __init__(self, d_micros: int):
        self.d = d_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_kept", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["cd_t", "cd_id"], kind="mergesort")
        last = self.last.get()[0] if self.last.exists() else None
        idx, new_last = keep_after(pdf["cd_t"].to_numpy(dtype=np.int64), last, self.d)
        if new_last is not None:
            self.last.update((new_last,))
        yield pdf.iloc[idx]

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, key: str, ts: str, seconds: float, id_col: str) -> DataFrame:
    """Streaming DataFrame of the kept events (append mode); needs the RocksDB state store."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    d = int(round(seconds * 1_000_000))
    src = events.withColumns({"cd_t": F.unix_micros(F.col(ts).cast("timestamp")), "cd_id": F.col(id_col)})
    schema = src.schema
    return src.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Cooldown(d), outputStructType=schema, outputMode="Append", timeMode="None",
    ).drop("cd_t", "cd_id")
