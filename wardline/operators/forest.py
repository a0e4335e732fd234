"""Distributed Isolation Forest (Liu, Ting and Zhou, ICDM 2008).

Spark does the work that grows with the data: the scaler in one aggregation, the subsamples by
hash thresholds, the scores in Arrow batches. A tree sees 256 rows, so the fitted forest has a
fixed size (trees x 511 nodes) whatever the table holds, and can be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wardline.operators.quantiles import exact_quantile
from wardline.session import materialize

# The model's parameters.
TREES = 200
SUBSAMPLE = 256
CONTAMINATION = 0.43
SEED = 42

GOLDEN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd numbers that spread picks
CHUNK = 10_000
EULER_GAMMA = 0.5772156649015329

NODES = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.DoubleType()),
    ]
)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


# --- scaler ------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population deviation per feature, as rows (position, feature, mean, std, n)."""
    values = df.select(F.posexplode(F.array(*features)).alias("position", "v"))
    totals = values.groupBy("position").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n")
    )
    name = F.get(F.array(*map(F.lit, features)), F.col("position"))
    return totals.select("position", name.alias("feature"), "mean", "std", "n")


def standardise(df: DataFrame, scaler: list, features: list[str]) -> DataFrame:
    """(x - mean) / std with the collected scaler rows; a constant feature is only centred."""
    by_name = {r["feature"]: r for r in scaler}

    def z(f: str) -> Column:
        mean, std = by_name[f]["mean"] or 0.0, by_name[f]["std"] or 1.0
        return ((F.col(f) - F.lit(mean)) / F.lit(std)).alias(f)

    return df.select(*[z(c) if c in by_name else F.col(c) for c in df.columns])


# --- sampling ----------------------------------------------------------------------------


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows chosen by hash of their id: the same under every partitioning."""
    return df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


def _lowest(trees: int, size: int, seed: int):
    """A task's ``size`` lowest picks of each tree, from batches of (id, key)."""
    shift = (np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed << 20)) * GOLDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks: list[np.ndarray] = [np.zeros(0, np.int64)] * trees
        ids: list[pa.Array | None] = [None] * trees
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64)
            for t in range(trees if len(key) else 0):
                pick = tree_picks(key, shift[t])
                if len(picks[t]) >= size:
                    near = np.flatnonzero(pick <= picks[t].max())
                else:
                    near = np.arange(len(pick))
                if not len(near):
                    continue
                both = np.concatenate([picks[t], pick[near]])
                names = batch.column(0).take(pa.array(near))
                names = names if ids[t] is None else pa.concat_arrays([ids[t], names])
                least = np.partition(both, size - 1)[size - 1] if len(both) > size else both.max()
                kept = np.flatnonzero(both <= least)
                picks[t], ids[t] = both[kept], names.take(pa.array(kept))
                if len(kept) > size:  # equal picks; Spark orders them by id, each id counts once
                    once = pa.table([picks[t], ids[t]], ["p", "id"]).group_by(["p", "id"]).aggregate([]).combine_chunks()
                    picks[t], ids[t] = once["p"].to_numpy(), once["id"].combine_chunks()
        for t in range(trees):
            if ids[t] is not None:
                n = len(picks[t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(picks[t]), ids[t]], ["tree", "pick", "_id"])

    return run


def tree_picks(key: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The order in which a tree draws rows: a hash of the row's key, as a number below 2 ** 63."""
    x = key + shift
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def tree_samples(df: DataFrame, id_col: str, trees: int, size: int, seed: int) -> DataFrame:
    """Rows (tree, pick, ...): for each tree the ``size`` rows of the whole table with the lowest picks.

    Picks are taken from the ids alone, each task keeping the lowest ones of every tree, so a pass over one
    column sends at most trees x size rows a task. They are merged in two steps, by tree and a sixteenth of the
    tree's rows, then by tree. The rows themselves are fetched for at most trees x size ids. Whole numbers are
    their own key, other ids are hashed. Ids should be unique; all rows of a repeated id are drawn with it.
    """
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    key = F.col(id_col).cast("long") if whole else F.xxhash64(id_col)
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(id_col).alias("_id"), F.coalesce(key, F.lit(0).cast("long")).alias("_key"))
    picks = narrow.mapInArrow(_lowest(trees, size, seed), f"tree int, pick long, _id {kind}").distinct()

    def merged(rows: DataFrame, *keys) -> DataFrame:
        order = Window.partitionBy("tree", *keys).orderBy("pick", "_id")
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size).drop("_rank")

    drawn = materialize(merged(merged(picks, F.col("pick") % 16)), "picks")
    same = df[id_col].eqNullSafe(drawn["_id"])
    return df.join(F.broadcast(drawn), same).drop("_id")


# --- fitting -----------------------------------------------------------------------------


def grow_tree(x: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple]:
    """Nodes (feature, threshold, left, rows, depth, path) of one isolation tree.

    Children are stored side by side, so ``left + 1`` is the right child. A leaf points to itself.
    """
    nodes: list[list] = [[-1, math.inf, 0, len(x), 0, 0.0]]
    todo = [(0, x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        usable = np.flatnonzero(hi > lo) if depth < height and len(rows) > 1 else []
        if len(usable) == 0:
            nodes[at] = [-1, math.inf, at, len(rows), depth, depth + average_path(len(rows))]
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(lo[f], hi[f])
        cut = min(max(cut, lo[f]), np.nextafter(hi[f], lo[f]))
        goes_left = rows[:, f] <= cut
        left = len(nodes)
        nodes[at] = [f, float(cut), left, len(rows), depth, 0.0]
        nodes += [[], []]
        todo += [(left, rows[goes_left], depth + 1), (left + 1, rows[~goes_left], depth + 1)]
    return [tuple(n) for n in nodes]


def fit_trees(samples: DataFrame, features: list[str], size: int, seed: int) -> DataFrame:
    """One task per tree; each holds ``size`` rows."""
    height = max(1, math.ceil(math.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pick", kind="stable")
        tree = int(pdf["tree"].iloc[0])
        grown = grow_tree(pdf[features].to_numpy(float), np.random.default_rng([seed, tree]), height)
        out = pd.DataFrame(grown, columns=["feature", "threshold", "left", "rows", "depth", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    return samples.select("tree", "pick", *features).groupBy("tree").applyInPandas(build, NODES)


@dataclass
class Forest:
    """A fitted model: scaler rows, node rows, and the score offset."""

    spark: SparkSession
    features: list[str]
    scaler: list
    nodes: pd.DataFrame
    sample_size: int
    offset: float
    seed: int = SEED

    # arrays for scoring ------------------------------------------------------------------

    def arrays(self) -> dict:
        nodes = self.nodes.sort_values(["tree", "node"], kind="stable")
        counts = nodes.groupby("tree").size().to_numpy()
        roots = np.concatenate([[0], np.cumsum(counts)[:-1]])
        shift = np.repeat(roots, counts)
        by_name = {r["feature"]: r for r in self.scaler}
        return {
            "roots": roots.astype(np.intp),
            "feature": np.maximum(nodes["feature"].to_numpy(), 0).astype(np.intp),
            "is_leaf": nodes["feature"].to_numpy() < 0,
            "threshold": nodes["threshold"].to_numpy(float),
            "left": (nodes["left"].to_numpy() + shift).astype(np.intp),
            "path": nodes["path"].to_numpy(float),
            "height": int(nodes["depth"].max()),
            "mean": np.array([by_name[f]["mean"] or 0.0 for f in self.features]),
            "std": np.array([by_name[f]["std"] or 1.0 for f in self.features]),
            "norm": average_path(self.sample_size),
        }

    def raw_score(self) -> Column:
        """Score in (-1, 0), lower meaning more anomalous; before the offset."""
        shared = self.spark.sparkContext.broadcast(self.arrays())

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for cols in batches:
                x = np.column_stack([c.to_numpy(float) for c in cols])
                yield pd.Series(score_rows(x, model))

        return score(*[F.col(f) for f in self.features])

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (offset applied) and ``prediction`` (-1 anomaly, 1 normal)."""
        return self.judge(df.withColumn("raw", self.raw_score()))

    def judge(self, scored: DataFrame) -> DataFrame:
        """Score and prediction from a stored ``raw`` column."""
        score = F.col("raw") - F.lit(self.offset)
        judged = scored.withColumn("anomaly_score", score).drop("raw")
        return judged.withColumn("prediction", prediction(F.col("anomaly_score")))


def prediction(score: Column) -> Column:
    return F.when(score < 0, -1).otherwise(1)


def mean_path(z: np.ndarray, model: dict) -> np.ndarray:
    """Average path length of standardised rows.

    One tree at a time over a chunk of rows, all rows one level down per step: a tree's few
    hundred nodes stay in the first cache. Leaves point to themselves, so every row takes the
    same number of steps.
    """
    out = np.empty(len(z))
    ends = np.append(model["roots"][1:], len(model["left"]))
    for start in range(0, len(z), CHUNK):
        part = z[start : start + CHUNK]
        n = len(part)
        by_feature = np.ascontiguousarray(part.T).ravel()
        rows, total = np.arange(n, dtype=np.intp), np.zeros(n)
        for root, end in zip(model["roots"], ends):
            first = model["feature"][root:end] * n  # where the node's feature begins in by_feature
            cut, left = model["threshold"][root:end], model["left"][root:end] - root
            at = np.zeros(n, dtype=np.intp)
            for _ in range(model["height"]):
                value = by_feature.take(first.take(at, mode="clip") + rows, mode="clip")
                right = value > cut.take(at, mode="clip")
                at = left.take(at, mode="clip") + right
            total += model["path"][root:end].take(at)
        out[start : start + n] = total / len(model["roots"])
    return out


def score_rows(x: np.ndarray, model: dict) -> np.ndarray:
    z = (x - model["mean"]) / model["std"]
    return -np.exp2(-mean_path(z, model) / max(model["norm"], 1e-12))


def fit_forest(
    df: DataFrame,
    id_col: str,
    features: list[str],
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> tuple[Forest, DataFrame]:
    """Fit scaler, trees and threshold. ``df`` should be a stored table: it is read three times.

    Returns the model and ``df`` stored again with its ``raw`` scores, so that the training table
    is scored once.
    """
    spark = df.sparkSession
    scaler = sorted(fit_scaler(df, features).collect())  # one row per feature
    if not scaler:
        raise ValueError("cannot fit a forest on an empty table")
    total = scaler[0]["n"]
    size = min(subsample, total)
    z = standardise(df.select(id_col, *features), scaler, features)
    samples = tree_samples(z, id_col, trees, size, seed)
    nodes = fit_trees(samples, features, size, seed).toPandas()  # at most trees x (2 size - 1) rows
    model = Forest(spark, features, scaler, nodes, size, 0.0, seed)
    raw = materialize(df.withColumn("raw", model.raw_score()), "training_scores")
    model.offset = exact_quantile(raw, "raw", contamination)
    return model, raw


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of events on which two sets of predictions agree."""
    other = right.select("access_id", F.col("prediction").alias("_other"))
    return _match_rate(left.select("access_id", "prediction").join(other, "access_id"))


def version_agreement(df: DataFrame, one: Forest, other: Forest) -> DataFrame:
    """Agreement of two model versions on the same events: one pass, no join."""
    first = one.score(df).withColumnRenamed("prediction", "_other").drop("anomaly_score")
    return _match_rate(other.score(first))


def _match_rate(df: DataFrame) -> DataFrame:
    same = F.col("prediction") == F.col("_other")
    return df.agg(
        F.count("*").alias("compared"),
        F.count_if(same).alias("equal"),
        F.avg(same.cast("double")).alias("match_rate"),
    )
