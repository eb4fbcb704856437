"""Isolation forest (ML3, ML4) on Spark.

Algorithm of Liu, Ting and Zhou (ICDM 2008): each tree isolates a random
sample of psi rows with random axis-parallel cuts up to height
ceil(log2 psi); a row's anomaly score is 2^(-E[h(x)] / c(psi)), where h adds
c(size) at a leaf that still holds ``size`` rows.

Spark layout:
* sampling: a hash of each row's key, mapped to [0, 1), keeps about
  ``n_trees * psi`` rows as a uniform pool (a Bernoulli sample: every task
  filters on its own, nothing is ordered or merged in one task; the
  sampling is the feature); each tree then draws its psi rows from the pool
  by a second, per-tree hash (``row_number() <= psi``, planned as a partial
  group limit).  No collect of the data, deterministic under re-execution.
* building: ``groupBy("tree").applyInPandas`` -- one task per tree, each
  with at most psi rows.
* scoring: the forest (at most n_trees x (2 psi - 1) nodes: a proven bound)
  is broadcast and ``mapInArrow`` scores Arrow batches with vectorised numpy
  traversal.
* threshold: the exact (1 - contamination) quantile of the training scores,
  computed distributed (``functions.stats``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import exact_quantile_value

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
])


#: Rows that walk down the trees at a time, so that a step's arrays stay in the processor's cache.
SCORED_ROWS = 8192


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(tree: int, x: np.ndarray, height_limit: int, seed: int) -> list[tuple]:
    """One isolation tree as node rows (feature -1 marks a leaf)."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, int(len(idx)), depth])
        if depth >= height_limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = grow(idx[go_left], depth + 1)
        right = grow(idx[~go_left], depth + 1)
        nodes[me][2], nodes[me][3], nodes[me][4], nodes[me][5] = f, thr, left, right
        return me

    grow(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def fit_isolation_forest(df: DataFrame, features: list[str], key: list[str], n_trees: int = 100,
                         sample_size: int = 256, seed: int = 42) -> DataFrame:
    """ML3: the forest as a node table (tree, node, feature, threshold, left,
    right, size, depth).  ``key`` columns identify a row for hashing."""
    rows = df.select(*key, *[F.col(c).cast("double").alias(c) for c in features])
    # pool: a uniform sample of about n_trees * psi rows, kept by a hash
    # threshold in every task (no ordering, nothing merged in one task)
    n = rows.count()
    fraction = min(1.0, n_trees * sample_size / max(n, 1))
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    unit = h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double") / F.lit(float(2 ** 63))
    pool = rows.where(unit < F.lit(fraction)) if fraction < 1.0 else rows
    draw = F.xxhash64(*[F.col(k) for k in key], F.col("tree"), F.lit(seed + 1))
    w = Window.partitionBy("tree").orderBy("_h2", *key)
    samples = (pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
               .withColumn("_h2", draw)
               .withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") <= sample_size)
               .select("tree", *features))
    psi = sample_size
    cols = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[cols].to_numpy(dtype=float)
        limit = int(math.ceil(math.log2(max(min(psi, len(x)), 2))))
        return pd.DataFrame(_build_tree(tree, x, limit, seed), columns=[f.name for f in NODE_SCHEMA.fields])

    return samples.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


class Forest:
    """The node table as flat numpy arrays (bounded by trees x nodes)."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        self.n_trees = int(nodes["tree"].nunique())
        per_tree = nodes.groupby("tree").size().to_numpy()
        start = np.concatenate([[0], np.cumsum(per_tree)[:-1]])
        base = np.repeat(start, per_tree)  # node ids are local to their tree
        self.root = start.astype(np.int64)
        self.feature = nodes["feature"].to_numpy(np.int64)
        self.threshold = nodes["threshold"].to_numpy(float)
        self.left = np.where(nodes["left"] >= 0, nodes["left"].to_numpy(np.int64) + base, -1)
        self.right = np.where(nodes["right"] >= 0, nodes["right"].to_numpy(np.int64) + base, -1)
        # a node's next one when its value is not below the threshold, or below it; a leaf stays
        inner, own = self.feature >= 0, np.arange(len(nodes))
        self.step = np.where(inner, np.stack([self.right, self.left]), own).T.astype(np.int64).ravel()
        self.asked = np.where(inner, self.feature, 0)
        self.levels = nodes.groupby("tree")["depth"].max().to_numpy()
        self.leaf_len = nodes["depth"].to_numpy(float) + c_factor(nodes["size"].to_numpy())
        # psi: the rows that the trees were given, min(sample size, rows there were)
        psi = int(nodes.loc[nodes["node"] == 0, "size"].max())
        self.c_psi = max(float(c_factor(np.array([psi]))[0]), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for start in range(0, len(x), SCORED_ROWS):
            part = np.ascontiguousarray(x[start:start + SCORED_ROWS].T)
            flat, n = part.ravel(), part.shape[1]
            rows, at = np.arange(n), self.asked * n
            node, place, value, cut, below = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n), np.empty(n, bool)
            for root, levels in zip(self.root, self.levels):
                node.fill(root)
                if levels:  # all rows are at the root
                    np.less(part[self.asked[root]], self.threshold[root], out=below)
                    np.take(self.step[2 * root:2 * root + 2], below.view(np.uint8), out=node, mode="clip")
                for _ in range(levels - 1):
                    # "clip" writes into ``out`` without a copy; all places are within bounds
                    np.take(at, node, out=place, mode="clip")
                    place += rows
                    np.take(flat, place, out=value, mode="clip")
                    np.take(self.threshold, node, out=cut, mode="clip")
                    np.less(value, cut, out=below)
                    node <<= 1
                    node += below
                    np.take(self.step, node, out=place, mode="clip")
                    node, place = place, node
                total[start:start + n] += self.leaf_len[node]
        return np.power(2.0, -(total / self.n_trees) / self.c_psi)


def score_isolation_forest(df: DataFrame, nodes: DataFrame, features: list[str],
                           out: str = "anomaly_score") -> DataFrame:
    """ML4 (scores): every row of ``df`` with its anomaly score."""
    # a bounded model, not data: sent once to each executor
    shared = df.sparkSession.sparkContext.broadcast(Forest(nodes.toPandas()))
    cols = list(features)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches):
        forest = shared.value
        for batch in batches:
            # the other columns pass as they are
            x = np.empty((batch.num_rows, len(cols)))
            for i, c in enumerate(cols):
                x[:, i] = batch.column(c).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def anomaly_threshold(train_scores: DataFrame, contamination: float = 0.05,
                      col: str = "anomaly_score") -> DataFrame:
    """One-row frame: the score above which a row is an anomaly."""
    return exact_quantile_value(train_scores.select(col), col, 1.0 - contamination)


def train_isolation_forest(df: DataFrame, features: list[str], key: list[str], n_trees: int = 100,
                           sample_size: int = 256, contamination: float = 0.05, seed: int = 42
                           ) -> tuple[DataFrame, float]:
    """ML3: fit the forest and its anomaly threshold on the training rows;
    returns (node table, threshold)."""
    nodes = fit_isolation_forest(df, features, key, n_trees, sample_size, seed)
    scored = score_isolation_forest(df, nodes, features)
    return nodes, float(anomaly_threshold(scored, contamination).first()["q"])


def score_anomaly(df: DataFrame, nodes: DataFrame, threshold: float, features: list[str]) -> DataFrame:
    """ML4: anomaly score, ``is_anomaly`` and the -1/1 label per row."""
    s = score_isolation_forest(df, nodes, features)
    return (s.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(threshold))
            .withColumn("anomaly_label", F.when(F.col("is_anomaly"), -1).otherwise(1)))
