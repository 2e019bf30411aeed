"""Isolation forest on Spark (Liu, Ting & Zhou, ICDM 2008).

fit:
  * features are cleaned (null/NaN/inf -> 0) and optionally standardised;
  * equal rows are counted, in one pass; the distinct rows with their counts
    are written once and serve the sample and the offset. A pool of about
    trees * psi rows (all rows, if fewer) is drawn, of n equal rows n * p of
    them, rounded up or down by a hash of their values: every row is as likely
    as any other, and the pool doesn't depend on partitions or order. Every
    tree draws psi rows of the pool without replacement;
  * ``groupBy("tree").applyInPandas`` grows one tree per group; the generator
    of a tree is seeded by (seed, tree);
  * the model is the node table (<= trees * (2 psi - 1) rows, fixed by the
    parameters, not by the data) and the offset: the ``contamination`` quantile
    of the training scores, found with the distributed exact quantile.

transform: a pandas UDF (Arrow batches) walks all trees at once, level by
level, with NumPy gathers; the node table is shipped to executors once per
task as a broadcast value.

Scores follow scikit-learn's convention: ``anomaly_score`` = -s(x) - offset,
``is_anomaly`` = anomaly_score < 0, s(x) = 2^(-E[h(x)] / c(psi)).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.functions.numeric import finite_or_zero
from adlens.operators.quantile import approx_quantile, exact_quantile
from adlens.operators.rows import stored
from adlens.session import ensure_checkpoint_dir

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size long, depth int"


def avg_path_length(n):
    """c(n): mean path length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    m = n > 2
    out[m] = 2.0 * (np.log(n[m] - 1.0) + EULER_GAMMA) - 2.0 * (n[m] - 1.0) / n[m]
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree as parallel lists (feature, split, left, right, size, depth)."""
    feat, split, left, right, size, depth = [], [], [], [], [], []

    def new(d, n):
        feat.append(-1), split.append(0.0), left.append(-1), right.append(-1), size.append(n), depth.append(d)
        return len(feat) - 1

    stack = [(np.arange(len(X)), 0, new(0, len(X)))]
    while stack:
        idx, d, me = stack.pop()
        if d >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(cand[rng.integers(len(cand))])
        s = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= s
        li, ri = idx[go_left], idx[~go_left]
        feat[me], split[me] = f, s
        left[me] = new(d + 1, len(li))
        right[me] = new(d + 1, len(ri))
        stack.append((ri, d + 1, right[me]))
        stack.append((li, d + 1, left[me]))
    return feat, split, left, right, size, depth


def _tree_builder(pool, psi: int, max_depth: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        X = pool.value[np.sort(rng.choice(len(pool.value), psi, replace=False))]
        feat, split, left, right, size, depth = _grow(X, rng, max_depth)
        n = len(feat)
        return pd.DataFrame({
            "tree": np.full(n, tree, dtype=np.int32), "node": np.arange(n, dtype=np.int32),
            "feature": np.asarray(feat, dtype=np.int32), "split": np.asarray(split, dtype=float),
            "left": np.asarray(left, dtype=np.int32), "right": np.asarray(right, dtype=np.int32),
            "size": np.asarray(size, dtype=np.int64), "depth": np.asarray(depth, dtype=np.int32),
        })
    return build


class IsolationForest:
    """Estimator: ``IsolationForest(feature_cols, n_trees=100).fit(df) -> IsolationForestModel``."""

    def __init__(self, feature_cols: list[str], n_trees: int = 100, max_samples: int = 256,
                 contamination: float = 0.1, seed: int = 42, scale: bool = False, exact_offset: bool = True,
                 fit_offset: bool = True):
        self.feature_cols = list(feature_cols)
        self.n_trees = n_trees
        self.max_samples = max_samples
        self.contamination = contamination
        self.seed = seed
        self.scale = scale
        self.exact_offset = exact_offset
        self.fit_offset = fit_offset

    def _prepared(self, df: DataFrame, stats: dict | None) -> DataFrame:
        cols = []
        for i, c in enumerate(self.feature_cols):
            x = finite_or_zero(c)
            if stats is not None:
                m, s = stats[f"m{i}"], stats[f"s{i}"]
                x = F.lit(0.0) if not s else (x - F.lit(m)) / F.lit(s)
            cols.append(x.alias(f"f{i}"))
        return df.select(*cols)

    def _counts(self, X: DataFrame) -> DataFrame:
        """Distinct rows of ``X`` with their number, as a checkpointed table."""
        ensure_checkpoint_dir(X.sparkSession)
        return X.groupBy(*X.columns).agg(F.count(F.lit(1)).alias("n")).checkpoint()

    def _draws(self, n: int, mark):
        """How many of ``n`` equal rows (column n) are drawn, by the hash of their values."""
        cap = self.n_trees * self.max_samples
        u = F.pmod(mark, F.lit(1 << 53)) / F.lit(float(1 << 53))
        return F.floor(F.col("n") * F.lit(min(1.0, cap / max(n, 1))) + u) if n > cap else F.col("n")

    def _drawn_counts(self, X: DataFrame) -> tuple[DataFrame, int]:
        """(distinct rows that may be drawn with their number, number of all rows).

        Rows are counted by their hash, which is all that is shuffled. Only rows of a hash that is drawn from are then
        counted by their values: rows that share a hash have one draw for all, so none that counts on its own is lost.
        """
        n, cols = X.count(), X.columns
        counted = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        if n > self.n_trees * self.max_samples:
            marked = X.withColumn("mark", F.xxhash64(*cols, F.lit(self.seed)))
            some = stored(counted(marked, "mark").where(self._draws(n, F.col("mark")) > 0).select("mark"), "marks")  # bounded by the parameters
            X = marked.join(F.broadcast(some), "mark", "left_semi").drop("mark")
        return counted(X, *cols), n

    def _pool(self, counts: DataFrame, n: int | None = None) -> np.ndarray:
        """About trees * psi rows (all, if fewer), each row as likely as any other, in an order of their own.

        ``n``: number of all rows, where ``counts`` holds only those that may be drawn.
        """
        n = n if n is not None else counts.agg(F.sum("n")).first()[0] or 0
        cols = [c for c in counts.columns if c != "n"]
        mark = F.xxhash64(*cols, F.lit(self.seed))
        drawn = counts.withColumn("k", self._draws(n, mark)).where("k > 0")
        got = drawn.withColumn("h", mark).orderBy("h", *cols).select("k", *cols).toPandas().to_numpy(dtype=float)  # bounded by the parameters
        return np.repeat(got[:, 1:], got[:, 0].astype(int), axis=0)

    def fit(self, df: DataFrame) -> IsolationForestModel:
        stats = None
        if self.scale:
            aggs = []
            for i, c in enumerate(self.feature_cols):
                aggs += [F.avg(finite_or_zero(c)).alias(f"m{i}"), F.stddev_pop(finite_or_zero(c)).alias(f"s{i}")]
            stats = df.agg(*aggs).first().asDict()
        X = self._prepared(df, stats)
        # the offset needs all distinct rows, the pool those that may be drawn
        counts = self._counts(X) if self.fit_offset and self.exact_offset else None
        pool = self._pool(counts) if counts is not None else self._pool(*self._drawn_counts(X))
        if not len(pool):
            raise ValueError("cannot fit an isolation forest on an empty table")
        psi = min(self.max_samples, len(pool))
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        spark = df.sparkSession
        held = spark.sparkContext.broadcast(pool)  # trees * psi rows at most
        trees = spark.range(self.n_trees).select(F.col("id").cast("int").alias("tree"))
        nodes = trees.groupBy("tree").applyInPandas(_tree_builder(held, psi, max_depth, self.seed), NODE_SCHEMA)
        node_pdf = nodes.toPandas()  # bounded: trees * (2 psi - 1) rows at most
        held.destroy()
        model = IsolationForestModel(self.feature_cols, node_pdf, psi, stats, offset=None,
                                     contamination=self.contamination)
        if self.fit_offset:
            model.offset = model.offset_of(counts) if counts is not None else model.fit_offset(df, exact=False)
        return model


class IsolationForestModel:
    def __init__(self, feature_cols, nodes: pd.DataFrame, psi: int, stats: dict | None, offset: float | None,
                 contamination: float = 0.1):
        self.feature_cols = list(feature_cols)
        self.nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        self.psi = int(psi)
        self.stats = stats
        self.offset = offset
        self.contamination = contamination

    # ---- arrays for vectorised scoring
    def _arrays(self):
        """Flat arrays over all trees; leaves loop to themselves (split +inf), so a walk needs no masks."""
        nd = self.nodes
        trees = np.sort(nd["tree"].unique())
        base = nd.groupby("tree")["node"].count().reindex(trees).cumsum().shift(fill_value=0).to_numpy()
        off = dict(zip(trees, base))
        gofs = nd["tree"].map(off).to_numpy()
        me = np.arange(len(nd), dtype=np.int64)
        leaf = nd["feature"].to_numpy() < 0
        left = np.where(leaf, me, nd["left"].to_numpy() + gofs)
        right = np.where(leaf, me, nd["right"].to_numpy() + gofs)
        leafval = nd["depth"].to_numpy(dtype=float) + avg_path_length(nd["size"].to_numpy())
        roots = np.asarray([off[t] for t in trees], dtype=np.int64)
        depth = int(nd["depth"].max()) if len(nd) else 0
        return {
            "feature": np.where(leaf, 0, nd["feature"].to_numpy()).astype(np.int64),
            "split": np.where(leaf, np.inf, nd["split"].to_numpy(dtype=float)),
            "child": np.stack([left, right], axis=1).astype(np.int64), "leafval": leafval,
            "roots": roots, "depth": depth, "cpsi": float(avg_path_length([self.psi])[0]),
        }

    @staticmethod
    def _score_block(X: np.ndarray, a: dict) -> np.ndarray:
        """Walk every row down every tree at once, one level per step (rows x trees node matrix)."""
        m = X.shape[0]
        node = np.broadcast_to(a["roots"], (m, len(a["roots"]))).copy()
        rows = np.arange(m)[:, None]
        feat, split, child = a["feature"], a["split"], a["child"]
        for _ in range(a["depth"]):
            go_right = X[rows, feat[node]] > split[node]   # features are finite; leaves compare with +inf
            node = child[node, go_right.astype(np.intp)]
        eh = a["leafval"][node].mean(axis=1)
        return np.power(2.0, -eh / a["cpsi"]) if a["cpsi"] > 0 else np.ones(m)

    def _score_of(self, spark: SparkSession, columns: list):
        """s(x) of prepared feature columns."""
        bc = spark.sparkContext.broadcast(self._arrays())
        k = len(self.feature_cols)

        @F.pandas_udf("double")
        def s_of(batch: pd.DataFrame) -> pd.Series:
            X = batch.to_numpy(dtype=float).reshape(len(batch), k)
            return pd.Series(IsolationForestModel._score_block(X, bc.value))

        return s_of(F.struct(*columns))

    def _score_col(self, df: DataFrame):
        prep = []
        for i, c in enumerate(self.feature_cols):
            x = finite_or_zero(c)
            if self.stats is not None:
                mm, ss = self.stats[f"m{i}"], self.stats[f"s{i}"]
                x = F.lit(0.0) if not ss else (x - F.lit(mm)) / F.lit(ss)
            prep.append(x.alias(f"f{i}"))
        return self._score_of(df.sparkSession, prep)

    def score_column(self, df: DataFrame):
        """s(x) in (0, 1]: higher = more isolated."""
        return self._score_col(df)

    def offset_from(self, neg_scores: DataFrame, exact: bool = True) -> float:
        """The ``contamination`` quantile of -s(x) (a one-column frame ``ns``, persisted by the caller)."""
        f = exact_quantile if exact else approx_quantile
        return float(f(neg_scores, "ns", self.contamination))

    def offset_of(self, counts: DataFrame) -> float:
        """The offset from distinct prepared rows (f0, f1, ...) and their number n: each is scored once."""
        cols = [F.col(f"f{i}") for i in range(len(self.feature_cols))]
        scored = counts.select((-self._score_of(counts.sparkSession, cols)).alias("ns"), "n").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return float(exact_quantile(scored, "ns", self.contamination, weight="n"))
        finally:
            scored.unpersist()

    def fit_offset(self, df: DataFrame, exact: bool = True) -> float:
        neg = df.select((-self._score_col(df)).alias("ns")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self.offset_from(neg, exact)
        finally:
            neg.unpersist()

    def flag(self, scored: DataFrame) -> DataFrame:
        """anomaly_score and is_anomaly from an ``iso_score`` column."""
        a = -F.col("iso_score") - F.lit(self.offset)
        return scored.withColumns({"anomaly_score": a, "is_anomaly": a < 0})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.flag(df.withColumn("iso_score", self._score_col(df)))

    # ---- persistence: the node table as Parquet plus one row of settings
    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"psi": self.psi, "offset": self.offset, "contamination": self.contamination,
                "features": ",".join(self.feature_cols)}
        if self.stats:
            meta.update({k: float(v) for k, v in self.stats.items()})
        spark.createDataFrame([meta]).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        meta = spark.read.json(f"{path}/meta").first().asDict()
        feats = meta["features"].split(",")
        stats = {k: v for k, v in meta.items() if k[:1] in "ms" and k[1:].isdigit()} or None
        return cls(feats, nodes, meta["psi"], stats, meta["offset"], meta["contamination"])
