"""D1-D6 in one call: choose features, guard, score, flag.

``method="iforest"`` fits the distributed isolation forest; ``method="zsum"``
is the deterministic score used where an oracle must reproduce the flag.
Both add ``anomaly_score`` (below 0 = flagged) and ``is_anomaly``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.features import all_stats, feature_columns, flag_by_contamination, guard_ok, zsum_score
from adlens.operators.iforest import IsolationForest
from adlens.operators.rows import stored


def _no_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})


def detect(df: DataFrame, method: str = "iforest", feature_cols: list[str] | None = None,
           contamination: float = 0.1, n_trees: int = 100, max_samples: int = 256, seed: int = 42,
           scale: bool = False, guard: bool = True, exact: bool = True, keep: list | None = None) -> DataFrame:
    """Score every row and flag about ``contamination`` of them.

    With ``guard`` (the lean pipeline's rule) fewer than 10 rows or a feature
    matrix without spread flags nothing. No features -> nothing flagged.
    With ``keep`` (a list) the forest's scores are computed once and persisted;
    the persisted frame is appended to ``keep`` for the caller to unpersist.
    """
    feats = feature_columns(df, feature_cols)
    stats = all_stats(df, feats)[0] if feats and method == "zsum" else None  # one pass for guard and score
    if not feats or (guard and not guard_ok(df, feats, stats=stats)):
        return _no_flags(df)
    if method == "zsum":
        flagged = flag_by_contamination(zsum_score(df, feats, stats=stats), contamination, exact=exact)
        return flagged.withColumn("anomaly_score", F.col("score") - F.col("threshold"))
    if method == "iforest":
        est = IsolationForest(feats, n_trees=n_trees, max_samples=max_samples, contamination=contamination,
                              seed=seed, scale=scale, exact_offset=exact, fit_offset=False)
        model = est.fit(df)
        # score once: the kept scores feed both the offset quantile and the flag
        scored = df.withColumn("iso_score", model.score_column(df))
        if keep is None:  # nothing cached past this call
            scored = stored(scored, "scores")
        else:
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            keep.append(scored)
        model.offset = model.offset_from(scored.select((-F.col("iso_score")).alias("ns")), exact)
        return model.flag(scored)
    raise ValueError(f"unknown method {method!r}; use 'iforest' or 'zsum'")
