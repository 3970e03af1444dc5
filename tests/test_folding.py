"""Folds by chunks against the sequence, and folds written down and read back."""

import numpy as np
import pandas as pd
import pytest

from tidegauge.config import ControlConfig, DriftConfig
from tidegauge.operators import adwin, control, drift, folding
from tidegauge.operators.folding import chunked_fold

TICKS = "stream_id string, t long, ts_us long, event_id string, n_history long, proposal double, over_mark double, under_mark double, drift_active boolean, frozen boolean"


def ticks(n, seed, stream="main", interval=5):
    rng = np.random.default_rng(seed)
    t = interval * np.arange(1, n + 1)
    walk = np.clip(0.9 + np.cumsum(rng.normal(0, 0.01, n)), 0.4, 1.1)
    return pd.DataFrame(
        {
            "stream_id": stream, "t": t, "ts_us": np.cumsum(rng.integers(1, 9_000_000, n)), "event_id": [f"e{i}" for i in range(n)],
            "n_history": np.minimum(t, 300), "proposal": walk, "over_mark": walk + 0.02, "under_mark": walk - 0.02,
            "drift_active": rng.random(n) < 0.1, "frozen": rng.random(n) < 0.05,
        }
    )


@pytest.mark.parametrize(("chunk", "feedback"), [(25, False), (60, True), (1000, False)])
def test_thresholds_by_chunks_equal_the_sequence(spark, chunk, feedback):
    cfg = ControlConfig(interval=5, min_history=20, initial_threshold=0.95, min_threshold=0.5, max_threshold=0.99, max_step=0.01, rate_feedback=feedback)
    n = 200
    streams = [ticks(n, 1), ticks(n // 2, 2, "other")]
    got = control.threshold_path(spark.createDataFrame(pd.concat(streams), TICKS), cfg, chunk).toPandas()
    for rows in streams:
        want = control.ThresholdFold(cfg).step(rows)
        mine = got[got.stream_id == rows.stream_id[0]].sort_values("t").reset_index(drop=True)
        pd.testing.assert_frame_equal(mine, want, check_dtype=False)
        assert want.changed.sum() > n // 20


class Sum:
    """A fold that never forgets: every round settles one chunk more."""

    FIELDS = {"total": "long"}

    def __init__(self):
        self.total = 0

    def dump(self):
        return {"total": self.total}

    def load(self, state):
        self.total = int(state["total"])

    def step(self, pdf):
        sums = self.total + pdf["v"].cumsum()
        self.total = int(sums.iloc[-1])
        return pdf[["k", "p"]].assign(total=sums)


def test_a_fold_that_never_forgets(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(k, p, int(rng.integers(1, 9))) for k in "ab" for p in range(0, 30, 3 if k == "a" else 1)], columns=["k", "p", "v"])
    got = chunked_fold(spark.createDataFrame(pdf, "k string, p long, v long"), ["k"], "p", 10, Sum, "k string, p long, total long")
    want = pdf.assign(total=pdf.groupby("k").v.cumsum())
    assert sorted(map(tuple, got.collect())) == sorted(want[["k", "p", "total"]].itertuples(index=False, name=None))
    assert chunked_fold(got.limit(0).selectExpr("k", "p", "total v"), ["k"], "p", 10, Sum, "k string, p long, total long").count() == 0


def test_history_keeps_quantiles_through_ties_and_turnover():
    rng = np.random.default_rng(4)
    history, rows = drift._History(50, 3), []
    for i in range(200):
        row = rng.integers(0, 6, 3) / 3.0
        history.add(row)
        rows.append(row)
        last = np.array(rows[-50:])
        assert np.allclose(history.quantile(0.9), np.quantile(last, 0.9, axis=0))
        assert np.allclose(history.spread(), last.std(axis=0))
        if i in (3, 49, 50, 77, 199):
            again = drift._History(50, 3)
            again.load(history.dump(), history.seen)
            assert np.array_equal(again.rows[: len(again)], history.rows[: len(history)]) and np.allclose(again.quantile(0.3), history.quantile(0.3))


class Row:
    def __init__(self, rng, u):
        self.stream_id, self.u, self.t, self.profile_id = "main", u, u + 10, 0
        self.psi, self.ks, self.mean_shift_z = rng.gamma(1, 0.3, 4), rng.gamma(1, 0.1, 4), rng.gamma(1, 1.0, 4)
        self.ks_critical = np.full(4, 0.1)
        self.score_psi, self.score_ks, self.score_ks_critical = rng.gamma(1, 0.3), rng.gamma(1, 0.1), 0.1
        self.adwin_detected = rng.random() < 0.1


def test_rounds_are_bounded_whatever_a_fold_remembers(spark, monkeypatch):
    """Thirty chunks of a fold that never forgets: few rounds in parallel, the rest in order."""
    staged = []
    monkeypatch.setattr(folding, "stage", lambda df, name, real=folding.stage: staged.append(name) or real(df, name))
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame([(k, p, int(rng.integers(1, 9))) for k in "ab" for p in range(60 if k == "a" else 4)], columns=["k", "p", "v"])
    got = chunked_fold(spark.createDataFrame(pdf, "k string, p long, v long"), ["k"], "p", 2, Sum, "k string, p long, total long")
    want = pdf.assign(total=pdf.groupby("k").v.cumsum())
    assert sorted(map(tuple, got.collect())) == sorted(want[["k", "p", "total"]].itertuples(index=False, name=None))
    assert staged.count("fold-round") == folding.ROUNDS


@pytest.mark.parametrize("chunk", [1, 3])
def test_drift_states_by_short_chunks_equal_the_sequence(spark, chunk):
    cfg = DriftConfig(history_evals=60, baseline_min_evals=5, critical_consecutive=1, interval=200)
    rng = np.random.default_rng(8)
    rows = pd.DataFrame([vars(Row(rng, 200 * (i + 1))) for i in range(24)])
    kinds = "stream_id string, u long, t long, profile_id int, psi array<double>, ks array<double>, mean_shift_z array<double>, ks_critical array<double>, score_psi double, score_ks double, score_ks_critical double, adwin_detected boolean"
    table = spark.createDataFrame([tuple(v.tolist() if hasattr(v, "tolist") else v for v in r) for r in rows.itertuples(index=False)], kinds)
    got = drift.drift_states(table, cfg, chunk).toPandas().sort_values("u")
    want = drift.DriftFold(cfg).step(rows)
    for c in ("drift_score", "drift_threshold", "vote_ratio", "drift_warning_active", "drift_active"):
        assert got[c].tolist() == want[c].tolist()


def test_prefix_of_the_adaptive_window_equals_merging_afresh():
    rng = np.random.default_rng(9)
    window, cuts = adwin.AdaptiveWindow(0.01), 0
    for i in range(400):
        cuts += window.add(32.0, float(rng.normal(i // 130, 0.05)), float(rng.gamma(2, 0.1)))
        whole = (0.0, 0.0, 0.0)
        for bucket in (b for level in reversed(window.levels) for b in level):
            whole = window._merge(whole, bucket)
        assert window.total == whole
    assert cuts >= 2


@pytest.mark.parametrize("mode", ["reference", "latched"])
def test_folds_go_on_after_they_are_written_down(mode):
    cfg = DriftConfig(mode=mode, history_evals=60, baseline_min_evals=5, critical_consecutive=1)
    whole, parts, rng = drift.DriftFold(cfg), drift.DriftFold(cfg), np.random.default_rng(5)
    window, pieces = adwin.AdaptiveWindow(0.01), adwin.AdaptiveWindow(0.01)
    seen = set()
    for i in range(300):
        row = Row(rng, 200 * (i + 1))
        a, b = whole.advance(row), parts.advance(row)
        assert all(np.array_equal(a[k], b[k]) for k in a)
        seen.add((a["drift_warning_active"], a["drift_active"]))
        block = (32.0, float(rng.normal(i // 100, 0.1)), float(rng.gamma(2, 1)))
        assert window.add(*block) == pieces.add(*block)
        if i % 37 == 0:
            state, parts = parts.dump(), drift.DriftFold(cfg)
            parts.load(state)
            held, pieces = pieces.dump(), adwin.AdaptiveWindow(0.01)
            pieces.load(held)
    assert len(seen) > 1 and window.levels == pieces.levels
