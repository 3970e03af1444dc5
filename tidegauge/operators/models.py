"""Unsupervised anomaly models: fitted once per stream on its warm-up rows, never retrained."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import ModelConfig
from tidegauge.functions.scalar import guard, squash, vector_norm
from tidegauge.session import hinted, stage

KEY = "stream_id"
TREES_PER_TASK = 4
# Trees that one pass over the rows holds in memory; more streams are scored in further passes.
BROADCAST_TREES = 4_000


class FittedModel(Protocol):
    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``raw_score`` and ``score`` added, null for streams without a model."""


class AnomalyModel(Protocol):
    def fit(self, warm: DataFrame, features: Sequence[str]) -> FittedModel:
        """Fit one model per stream; ``warm`` holds whole warm-up sets only."""


class FittedZScore:
    def __init__(self, params: DataFrame, features: Sequence[str]) -> None:
        self.params, self.features = params, list(features)

    def transform(self, rows: DataFrame) -> DataFrame:
        norm = vector_norm(self.features)
        joined = rows.join(hinted(self.params), KEY, "left")
        raw = (norm - F.col("norm_mean")) / F.col("norm_scale")
        scored = joined.withColumn("raw_score", raw)
        score = squash(F.col("raw_score"), F.col("raw_mean"), F.col("raw_std"))
        return scored.withColumn("score", score).select(*rows.columns, "raw_score", "score")


class ZScoreModel:
    """Distance of the vector norm from its warm-up mean, in warm-up spreads.

    The spread starts from a variance sum of 1. Everything comes from one aggregate: the raw
    score is linear in the norm, so its own mean and spread follow from those of the norm.
    """

    def fit(self, warm: DataFrame, features: Sequence[str]) -> FittedZScore:
        norm = vector_norm(features).alias("norm")
        stats = warm.select(KEY, norm).groupBy(KEY).agg(
            F.avg("norm").alias("norm_mean"),
            F.var_pop("norm").alias("_var"),
            F.count(F.lit(1)).alias("n"),
        )
        spread = (F.lit(1.0) + F.col("_var") * F.col("n")) / F.greatest(F.lit(1), F.col("n") - 1)
        scale = F.sqrt(F.greatest(F.lit(1e-9), spread))
        stats = stats.withColumn("norm_scale", scale)
        raw_std = F.sqrt("_var") / F.col("norm_scale")
        params = stats.select(
            KEY, "n", "norm_mean", "norm_scale", F.lit(0.0).alias("raw_mean"),
            F.when(raw_std == 0.0, F.lit(1.0)).otherwise(raw_std).alias("raw_std"),
        )
        return FittedZScore(stage(params, "model"), features)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def draw(*parts: object) -> float:
    """Number in [0, 1) from a text key, the same wherever and whenever it is drawn."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _sample(positions: np.ndarray, seed: int, tree: int, psi: int) -> np.ndarray:
    """Places of the ``psi`` rows whose positions draw the smallest numbers."""
    drawn = np.array([draw(seed, tree, int(p)) for p in positions])
    return np.lexsort((positions, drawn))[:psi]


def _grow(x: np.ndarray, seed: int, tree: int, depth_limit: int) -> dict[str, list]:
    """One isolation tree in heap order (node i has children 2i and 2i + 1); leaves have feature -1 and a path.

    A node's feature, among those that differ in its rows, and its split between their extremes are drawn by the
    node's number.
    """
    size = 1 << (depth_limit + 1)
    feature, split, path = [-1] * size, [0.0] * size, [0.0] * size
    todo = [(1, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(usable) == 0:
            path[node] = depth + average_path(len(rows))
            continue
        f = int(usable[int(draw(seed, tree, node, "feature") * len(usable))])
        at = float(low[f] + draw(seed, tree, node, "split") * (high[f] - low[f]))
        feature[node], split[node] = f, at
        goes_left = part[:, f] <= at
        todo += [(2 * node, depth + 1, rows[goes_left]), (2 * node + 1, depth + 1, rows[~goes_left])]
    return {"feature": feature, "split": split, "path": path}


FOREST_SCHEMA = f"{KEY} string, tree int, psi int, feature array<int>, split array<double>, path array<double>"


def _anomaly(x: np.ndarray, trees: Sequence, psi: int) -> np.ndarray:
    """2 ** (-mean path / expected path) for a matrix, all rows walking a tree together."""
    total = np.zeros(len(x))
    for feature, split, path in trees:
        node = np.ones(len(x), dtype=np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            open_ = open_[feature[node[open_]] >= 0]
            n = node[open_]
            node[open_] = 2 * n + (x[open_, feature[n]] > split[n])
        total += path[node]
    return np.exp2(-(total / len(trees)) / max(average_path(psi), 1e-9))


def _as_trees(pdf: pd.DataFrame) -> tuple[list, int]:
    trees = [
        (np.asarray(row.feature, dtype=np.int64), np.asarray(row.split, dtype=float), np.asarray(row.path, dtype=float))
        for row in pdf.sort_values("tree").itertuples()
    ]
    return trees, int(pdf["psi"].iloc[0])


def _scorer(shipped, xs: list[str]):
    """Scores rows of the streams in ``shipped`` and passes the others on."""

    def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = pdf["raw_score"].to_numpy(dtype=float, copy=True)
            for key, at in pdf.groupby(KEY).indices.items():
                if key in shipped.value:
                    trees, psi = shipped.value[key]
                    raw[at] = _anomaly(pdf[xs].to_numpy()[at], trees, psi)
            yield pdf.assign(raw_score=raw)

    return score_batches


class FittedForest:
    def __init__(self, forest: DataFrame, features: Sequence[str], norms: DataFrame | None = None) -> None:
        self.forest, self.features, self.norms = forest, list(features), norms

    def raw(self, rows: DataFrame) -> DataFrame:
        names = self.features
        guarded = rows.select("*", *[guard(c).alias(f"_x_{c}") for c in names])
        xs = [f"_x_{c}" for c in names]
        scored = guarded.withColumn("raw_score", F.lit(None).cast("double"))
        schema = scored.schema
        # Passes of bounded model size, chained without a shuffle; tables and streams alike.
        for some in self._blocks():
            table = {k: _as_trees(g) for k, g in some.toPandas().groupby(KEY)}
            scored = scored.mapInPandas(_scorer(rows.sparkSession.sparkContext.broadcast(table), xs), schema)
        return self._nulls(scored.select(*rows.columns, "raw_score"))

    def _blocks(self) -> list[DataFrame]:
        """The forest by ranges of streams with at most ``BROADCAST_TREES`` trees each, or one stream."""
        sizes = self.forest.groupBy(KEY).count().orderBy(KEY)
        blocks, first, held, last = [], None, 0, None
        for row in sizes.toLocalIterator():
            if first is not None and held + row["count"] > BROADCAST_TREES:
                blocks.append((first, last))
                first, held = None, 0
            first = row[KEY] if first is None else first
            held, last = held + row["count"], row[KEY]
        if first is not None:
            blocks.append((first, last))
        return [self.forest.filter(F.col(KEY).between(a, b)) for a, b in blocks]

    @staticmethod
    def _nulls(rows: DataFrame) -> DataFrame:
        return rows.withColumn("raw_score", F.when(~F.isnan("raw_score"), F.col("raw_score")))

    def transform(self, rows: DataFrame) -> DataFrame:
        assert self.norms is not None
        scored = self.raw(rows).join(hinted(self.norms), KEY, "left")
        score = squash(F.col("raw_score"), F.col("raw_mean"), F.col("raw_std"))
        return scored.withColumn("score", score).select(*rows.columns, "raw_score", "score")


class IsolationForestModel:
    """Isolation forest; blocks of trees are grown as separate tasks from the bounded warm-up.

    What is random is drawn from texts of seed, tree and node (or position), so any engine grows the same trees. Rows
    are scored in Arrow batches that walk a tree together: two hundred walks a row as column expressions
    take several times as long.
    """

    def __init__(self, cfg: ModelConfig) -> None:
        self.cfg = cfg

    def fit(self, warm: DataFrame, features: Sequence[str]) -> FittedForest:
        cfg, names = self.cfg, list(features)
        blocks = math.ceil(cfg.n_trees / TREES_PER_TASK)
        rows = warm.select(KEY, "idx", *[guard(c).alias(c) for c in names]).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )

        def grow_block(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            x, positions = pdf[names].to_numpy(dtype=float), pdf["idx"].to_numpy()
            psi = min(cfg.subsample, len(x))
            limit = max(1, math.ceil(math.log2(max(psi, 2))))
            out = []
            for tree in range(int(pdf["block"].iloc[0]), cfg.n_trees, blocks):
                sample = x[_sample(positions, cfg.seed, tree, psi)]
                out.append({KEY: pdf[KEY].iloc[0], "tree": tree, "psi": psi, **_grow(sample, cfg.seed, tree, limit)})
            return pd.DataFrame(out)

        forest = rows.groupBy(KEY, "block").applyInPandas(grow_block, FOREST_SCHEMA)
        fitted = FittedForest(stage(forest, "forest"), names)
        raw = fitted.raw(warm).groupBy(KEY).agg(
            F.avg("raw_score").alias("raw_mean"), F.stddev_pop("raw_score").alias("_std")
        )
        raw_std = F.when(F.col("_std") == 0.0, F.lit(1.0)).otherwise(F.col("_std"))
        fitted.norms = stage(raw.select(KEY, "raw_mean", raw_std.alias("raw_std")), "model")
        return fitted


def model_for(cfg: ModelConfig) -> AnomalyModel:
    if cfg.kind == "zscore":
        return ZScoreModel()
    if cfg.kind == "isolation_forest":
        return IsolationForestModel(cfg)
    raise ValueError(f"unknown model kind: {cfg.kind}")
