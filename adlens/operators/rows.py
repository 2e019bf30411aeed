"""Small helpers on whole tables: one-row tables side by side, and a table read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import ensure_checkpoint_dir, scratch_dir


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row: a union of rows with gaps and one aggregate, no join."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.agg(*[F.first(c, ignorenulls=True).alias(c) for c in whole.columns])


def once(df: DataFrame) -> DataFrame:
    """``df`` as a checkpointed table, for operators that read it more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as Parquet in the shared scratch folder, for several passes that read some of the columns each.

    Joins and scores behind ``df`` run once; a small result has its true size for the planner's broadcast check.
    """
    path = scratch_dir(df.sparkSession, name)
    void = [c for c, t in df.dtypes if t == "void"]  # Parquet has no such type
    kept = df.drop(*void)
    kept.write.parquet(path)
    out = df.sparkSession.read.schema(kept.schema).parquet(path)
    return out.withColumns({c: F.lit(None) for c in void}).select(*df.columns) if void else out
