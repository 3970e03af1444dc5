from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.naive import NaiveController
from tidegauge.config import ControlConfig
from tidegauge.operators import control

SCHEMA = "stream_id string, t long, ts_us long, event_id string, score double"


def scores_frame(spark, scores):
    rows = [("main", i + 1, (i + 1) * 1_000_000, f"e{i}", float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, SCHEMA)


def run_path(spark, scores, cfg, drift=False, frozen=None):
    ticks = control.tick_quantiles(scores_frame(spark, scores), cfg).withColumns(
        {"drift_active": F.lit(drift), "frozen": F.lit(False) if frozen is None else frozen}
    )
    return control.threshold_path(ticks, cfg)


def naive_path(scores, cfg, drift=False):
    c = NaiveController(cfg)
    return [c.update(float(s), float(i + 1), drift) for i, s in enumerate(scores)]


CASES = {
    "sawtooth": (
        [(i % 1000) / 1000.0 for i in range(1, 4001)],
        ControlConfig(target_rate=0.1, initial_threshold=0.5, min_threshold=0.0, max_threshold=1.0, max_step=1.0,
                      cooldown_seconds=0, min_history=200, history=4000, interval=7),
    ),
    "steps_and_cooldown": (
        list(np.random.default_rng(2).beta(2, 5, 600)) + [float("nan"), float("inf")] + list(np.random.default_rng(3).beta(5, 2, 600)),
        ControlConfig(target_rate=0.05, initial_threshold=0.5, min_threshold=0.3, max_threshold=0.9, max_step=0.03,
                      cooldown_seconds=20, min_history=50, history=128, interval=3),
    ),
    "feedback": (
        [0.90 + (i % 1000) / 10000.0 for i in range(1, 3001)],
        ControlConfig(target_rate=0.01, initial_threshold=0.9960, min_threshold=0.0, max_threshold=1.0, max_step=0.001,
                      cooldown_seconds=1, min_history=100, history=6000, interval=5, rate_feedback=True, tolerance=0.0025),
    ),
    "feedback_on_ties": (
        list(np.round(np.random.default_rng(4).beta(8, 2, 1500), 2)),
        ControlConfig(target_rate=0.1, initial_threshold=0.9, min_threshold=0.5, max_threshold=0.99, max_step=0.01,
                      cooldown_seconds=0, min_history=20, history=200, interval=2, rate_feedback=True, tolerance=0.01),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_path_equals_per_event_controller(spark, name, monkeypatch):
    scores, cfg = CASES[name]
    monkeypatch.setattr(control, "TICK_CHUNK", 500)  # several chunks with halos
    want = naive_path(scores, cfg)
    got = {r.t: r.threshold for r in run_path(spark, scores, cfg).collect()}
    assert len(got) == len(scores) // cfg.interval
    for t, threshold in got.items():
        assert threshold == pytest.approx(want[t - 1], abs=1e-12), t


def test_converges_to_target_rate(spark):
    scores, cfg = CASES["sawtooth"]
    rows = scores_frame(spark, scores)
    judged = control.with_threshold(rows, run_path(spark, scores, cfg), cfg)
    head = control.recent_rate(judged, cfg).first()
    assert 0.88 <= head.threshold <= 0.92 and abs(head.recent_rate - 0.1) <= 0.02


def test_no_change_in_drift_or_when_disabled(spark):
    scores, cfg = CASES["sawtooth"]
    assert run_path(spark, scores[:500], cfg, drift=True).filter("changed").isEmpty()
    off = ControlConfig(enabled=False, min_history=1, interval=1)
    assert run_path(spark, scores[:100], off).filter("changed").isEmpty()


def test_counters_cover_every_event(spark):
    scores, cfg = CASES["steps_and_cooldown"]
    rows = scores_frame(spark, scores).withColumns({"drift_active": F.col("t") % 50 == 0, "frozen": F.lit(False)})
    ticks = control.tick_quantiles(rows, cfg).withColumns({"drift_active": F.col("t") % 50 == 0, "frozen": F.lit(False)})
    path = control.threshold_path(ticks, cfg)
    head = control.control_counters(control.skip_reasons(rows, path, cfg), path).first()
    naive = dict.fromkeys(("drift", "cooldown", "history", "interval"), 0)
    c = NaiveController(cfg)
    for i, s in enumerate(scores, 1):
        finite = sum(np.isfinite(scores[:i]))
        if i % 50 == 0:
            naive["drift"] += 1
        elif c.last is not None and i - c.last < cfg.cooldown_seconds:
            naive["cooldown"] += 1
        elif min(finite, cfg.history) < cfg.min_history:
            naive["history"] += 1
        elif i % cfg.interval:
            naive["interval"] += 1
        c.update(float(s), float(i), i % 50 == 0)
    assert {k: head[f"skipped_{k}"] for k in naive} == naive


def test_freeze_and_release_by_action_time(spark):
    rows = spark.createDataFrame([("main", i * 1_000_000, f"e{i}") for i in range(10)], "stream_id string, ts_us long, event_id string")
    acts = spark.createDataFrame(
        [("main", 2_500_000, control.FREEZE, None, None), ("main", 6_000_000, control.UNFREEZE, "ann", "ok"), ("main", 7_000_000, control.REFRESH, None, None)],
        "stream_id string, ts_us long, action string, actor string, reason string",
    )
    got = [r.frozen for r in control.latest_action(rows, acts).orderBy("ts_us").collect()]
    assert got == [False] * 3 + [True] * 3 + [False] * 4
    audit = {r.action: (r.actor, r.reason) for r in control.control_audit(acts).collect()}
    assert audit[control.FREEZE] == ("unknown", "manual_freeze") and audit[control.UNFREEZE] == ("ann", "ok")


def test_lag_circuit_opens_once_until_released(spark):
    lags = [(0, 1.0), (1, 6.0), (2, 9.0), (4, 7.0), (6, 0.1), (7, 8.0)]
    rows = spark.createDataFrame([("main", s * 1_000_000, f"e{s}", v) for s, v in lags], "stream_id string, ts_us long, event_id string, lag_s double")
    releases = spark.createDataFrame([("main", 3_000_000), ("main", 5_000_000)], "stream_id string, ts_us long")
    got = sorted(r.event_id for r in control.circuit_openings(rows, releases, ControlConfig()).collect())
    assert got == ["e1", "e4", "e7"]
