from __future__ import annotations

import numpy as np
import pytest

from tidegauge.config import ModelConfig
from tidegauge.operators import models

NAMES = ["a", "b"]


def frame(spark, x, stream="main", start=0):
    rows = [(stream, start + i + 1, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream_id string, idx long, a double, b double")


def test_zscore_equals_running_formulas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (200, 2))
    x[5] = [np.nan, np.inf]
    clean = np.clip(np.nan_to_num(x, nan=0.0, posinf=1e6, neginf=-1e6), -1e6, 1e6)
    norms = np.linalg.norm(clean, axis=1)
    mean, spread, n = 0.0, 1.0, 0
    for v in norms:
        n += 1
        before = v - mean
        mean += before / n
        spread += before * (v - mean)
    raw = (norms - mean) / np.sqrt(max(1e-9, spread / (n - 1)))
    want = 1 / (1 + np.exp(-(raw - raw.mean()) / (raw.std() + 1e-9)))
    df = frame(spark, x)
    got = models.ZScoreModel().fit(df, NAMES).transform(df).orderBy("idx").collect()
    assert [r.raw_score for r in got] == pytest.approx(list(raw), rel=1e-9, abs=1e-9)
    assert [r.score for r in got] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_zscore_of_constant_rows_is_half(spark):
    df = frame(spark, np.ones((20, 2)))
    got = models.ZScoreModel().fit(df, NAMES).transform(df).collect()
    assert all(r.score == pytest.approx(0.5) for r in got)


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(1)
    calm = rng.normal(0, 1, (400, 2))
    model = models.IsolationForestModel(ModelConfig(n_trees=60, subsample=128))
    warm = frame(spark, calm).unionByName(frame(spark, calm + 50, "far"))
    return model.fit(warm, NAMES), calm


def test_forest_ranks_outliers_on_top(spark, forest):
    fitted, calm = forest
    rows = np.vstack([calm[:200], [[9, 9], [-8, 7], [10, -12]]])
    got = fitted.transform(frame(spark, rows)).orderBy("idx").collect()
    raw = np.array([r.raw_score for r in got])
    assert {200, 201, 202} <= set(np.argsort(raw)[-6:])
    assert 0 < raw.min() and raw.max() < 1 and 0.35 < np.median(raw) < 0.55
    assert all(0 < r.score < 1 for r in got)


def test_forest_is_repeatable_and_kept_per_stream(spark, forest):
    fitted, calm = forest
    rows = frame(spark, calm[:50] + 50, "far")
    again = sorted(r.raw_score for r in fitted.transform(rows).collect())
    assert again == sorted(r.raw_score for r in fitted.transform(rows).collect())
    assert np.median(again) < 0.55
    wrong = [r.raw_score for r in fitted.transform(frame(spark, calm[:50], "far")).collect()]
    assert np.median(wrong) > np.median(again)


def test_forests_of_many_streams_are_scored_in_passes(spark, forest, monkeypatch):
    """One stream a pass, on rows without a position, as a stream of rows has them."""
    fitted, calm = forest
    rows = frame(spark, calm[:100]).unionByName(frame(spark, calm[:100] + 50, "far"))
    small = {(r.stream_id, r.idx): r.raw_score for r in fitted.raw(rows).collect()}
    monkeypatch.setattr(models, "BROADCAST_TREES", 0)
    assert len(fitted._blocks()) == 2
    big = {(r.stream_id, r.place): r.raw_score for r in fitted.raw(rows.withColumnRenamed("idx", "place")).collect()}
    assert big.keys() == small.keys() and all(big[k] == pytest.approx(small[k]) for k in big)


def test_average_path():
    assert models.average_path(1) == 0 and models.average_path(2) == 1
    assert models.average_path(256) == pytest.approx(10.244, abs=1e-3)


def test_unknown_model():
    with pytest.raises(ValueError):
        models.model_for(ModelConfig(kind="nearest"))
