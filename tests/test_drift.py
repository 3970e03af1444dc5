from __future__ import annotations

import math
from collections import deque
from dataclasses import replace

import numpy as np
import pytest

from tests.naive import edges_of, ks_frozen, psi_frozen
from tidegauge.config import ControlConfig, DriftConfig, EngineConfig, FeatureConfig, ModelConfig
from tidegauge.operators import adwin, drift, profile, windows
from tidegauge.plans.scoring import ScoringRun

BASE = DriftConfig(
    reference_events=100, window_size=50, interval=5, min_samples=20, feature_ks_p=0.01, feature_psi=0.2, pred_ks_p=0.01,
    pred_psi=0.2, alert_cooldown_events=0, baseline_min_evals=5, feature_alert_score=0.9, warning_enter=0.9, warning_exit=0.7,
    critical_enter=1.1, critical_exit=0.9, warning_vote=0.25, critical_vote=0.45, critical_consecutive=2, adwin_enabled=False,
)
NAMES = ("f1", "f2", "f3", "f4")


def frame(spark, rows):
    schema = "stream_id string, t long, ts_us long, event_id string, " + ", ".join(f"{n} double" for n in NAMES) + ", score double"
    return spark.createDataFrame([("main", i + 1, (i + 1) * 1_000_000, f"e{i}", *map(float, r)) for i, r in enumerate(rows)], schema)


def states(spark, rows, cfg):
    scored = frame(spark, rows)
    base = profile.reference_profile(scored, cfg, NAMES)
    panes = profile.pane_stats(scored, base, cfg, NAMES)
    evaluations = drift.evaluation_rows(profile.windowed_distances(panes, base, cfg), NAMES)
    from pyspark.sql import functions as F

    return drift.drift_states(evaluations.withColumn("adwin_detected", F.lit(False)), cfg)


def norm(x, cap):
    return min(math.log1p(max(0.0, x)), cap)


def critical_ks(n, m, p):
    return math.sqrt(-0.5 * math.log(p / 2)) * math.sqrt((n + m) / (n * m))


def naive_states(rows, cfg):
    """Event by event, whole windows recomputed at each evaluation."""
    ref = np.array(rows[: cfg.reference_events], dtype=float)
    window = deque(maxlen=cfg.window_size)
    out, hist = [], {"score": [], "psi": [[] for _ in NAMES], "ks": [[] for _ in NAMES]}
    warn_run = crit_run = 0
    warn = crit = False
    last = -(10**9)
    for u, row in enumerate(rows[cfg.reference_events :], 1):
        window.append(row)
        if len(window) < cfg.min_samples or u % cfg.interval:
            if cfg.mode == "reference":
                warn = crit = False
            continue
        cur = np.array(window, dtype=float)
        fus, pn, kn, psis, kss = [], [], [], [], []
        for j in range(len(NAMES)):
            def limit(values, floor):
                if len(values) < cfg.baseline_min_evals:
                    return floor
                return max(floor, np.quantile(values, cfg.adaptive_quantile) + cfg.feature_threshold_k * np.std(values))

            p = psi_frozen(ref[:, j], cur[:, j])
            k = ks_frozen(ref[:, j], cur[:, j]) / critical_ks(len(ref), len(cur), cfg.feature_ks_p)
            z = abs(cur[:, j].mean() - ref[:, j].mean()) / (ref[:, j].std() + 1e-9)
            pn.append(norm(p / limit(hist["psi"][j], cfg.feature_psi), cfg.norm_cap))
            kn.append(norm(k / limit(hist["ks"][j], 1.0), cfg.norm_cap))
            fus.append(0.55 * pn[-1] + 0.30 * kn[-1] + 0.15 * norm(z / cfg.mean_shift_z, cfg.norm_cap))
            psis.append(p)
            kss.append(k)
        sp = norm(psi_frozen(ref[:, -1], cur[:, -1]) / cfg.pred_psi, cfg.norm_cap)
        sk = norm(ks_frozen(ref[:, -1], cur[:, -1]) / critical_ks(len(ref), len(cur), cfg.pred_ks_p), cfg.norm_cap)
        score = 0.5 * np.mean(pn) + 0.3 * np.mean(kn) + 0.2 * (0.5 * sp + 0.5 * sk)
        vote = sum(f >= cfg.feature_alert_score for f in fus) / len(NAMES)
        thr = cfg.fixed_score_threshold
        if cfg.threshold_method == "adaptive" and len(hist["score"]) >= cfg.baseline_min_evals:
            thr = max(thr, np.quantile(hist["score"], cfg.adaptive_quantile))
        if warn:
            w = score >= thr * cfg.warning_exit and vote >= cfg.warning_vote * 0.8
        else:
            w = score >= thr * cfg.warning_enter and vote >= cfg.warning_vote and np.mean(fus) >= cfg.feature_alert_score * 0.9
        warn_run = warn_run + 1 if w else 0
        was, warn = crit, warn_run >= cfg.warning_consecutive
        if was:
            c = score >= thr * cfg.critical_exit and vote >= cfg.critical_vote * 0.8
        else:
            c = warn and score >= thr * cfg.critical_enter and vote >= cfg.critical_vote and np.mean(fus) >= cfg.feature_alert_score
        crit_run = crit_run + 1 if c else 0
        if was and c:
            crit = True
        elif crit_run >= cfg.critical_consecutive and u - last >= cfg.alert_cooldown_events:
            crit, last = True, u
        else:
            crit = False
        if (vote <= cfg.warning_vote * 0.8 and not was) or len(hist["score"]) < max(50, 3 * cfg.baseline_min_evals):
            hist["score"].append(score)
            for j in range(len(NAMES)):
                hist["psi"][j].append(psis[j])
                hist["ks"][j].append(kss[j])
        out.append((u, score, thr, vote, warn, crit))
    return out


def mixed_rows(seed=1):
    rng = np.random.default_rng(seed)
    calm = rng.normal(0, 1, (500, 5))
    moved = rng.normal(0, 1, (120, 5)) + np.array([3, 3, 3, 0, 2])
    return np.vstack([calm, moved, rng.normal(0, 1, (150, 5)), np.round(moved, 0), rng.normal(0, 1, (60, 5))]).tolist()


@pytest.mark.parametrize(
    "cfg",
    [
        BASE,
        replace(BASE, mode="latched", alert_cooldown_events=40),
        replace(BASE, interval=1, window_size=30),
        replace(BASE, interval=8, window_size=50, threshold_method="fixed"),
    ],
    ids=["reference", "latched", "every_event", "uneven_panes"],
)
def test_states_equal_event_by_event_monitor(spark, cfg, monkeypatch):
    monkeypatch.setattr(profile, "PANE_CHUNK", 16)
    rows = mixed_rows()
    want = naive_states(rows, cfg)
    got = states(spark, rows, cfg).orderBy("u").collect()
    assert [r.u for r in got] == [w[0] for w in want]
    assert any(w[5] for w in want)
    for r, (u, score, thr, vote, warn, crit) in zip(got, want):
        assert (r.drift_score, r.drift_threshold, r.vote_ratio) == pytest.approx((score, thr, vote), abs=1e-9), u
        assert (r.drift_warning_active, r.drift_active) == (warn, crit), u


def test_one_shifted_feature_is_not_enough_three_are(spark):
    calm = [[0.1 * (j + 1) + (i % 10) / 100 for j in range(4)] + [0.2 + (i % 10) / 100] for i in range(160)]
    for row in calm[100:]:
        row[0] = 0.8
    strong = [[4.0, 4.0, 4.0, 0.1, 0.9]] * 80
    got = states(spark, calm + strong, BASE).collect()
    assert not any(r.drift_active for r in got if r.u <= 60)
    hit = [r for r in got if r.drift_active]
    assert hit and hit[0].vote_ratio >= 0.5


def test_periodic_checks_lag_by_at_most_one_interval(spark):
    rows = [[0.1, 0.2, 0.1, 0.2, 0.2]] * 40 + [[0.11, 0.19, 0.11, 0.19, 0.21]] * 80 + [[4.0, -3.5, 4.0, -3.5, 0.95]] * 120
    cfg = replace(BASE, reference_events=40, window_size=20, min_samples=10)
    full = states(spark, rows, replace(cfg, interval=1)).filter("u > 80").collect()
    sparse = states(spark, rows, replace(cfg, interval=20)).filter("u > 80").collect()
    assert min(r.u for r in sparse) - min(r.u for r in full) <= 20
    assert max(r.drift_score for r in sparse) >= 0.8 * max(r.drift_score for r in full)


def test_profile_of_ties_has_padded_edges(spark):
    scored = frame(spark, [[1.0, 1.0, 2.0, float(i % 2), 0.5] for i in range(100)])
    got = {r.feature: r for r in profile.reference_profile(scored, BASE, NAMES).collect()}
    assert got["f1"].edges[0] == 1.0 - 1e-9 and got["f1"].edges[-1] == 1.0 + 1e-9
    assert got["f4"].edges == pytest.approx(list(edges_of(np.arange(100) % 2.0)))


def test_short_stream_has_no_profile(spark):
    scored = frame(spark, [[1.0] * 5] * 99)
    assert profile.reference_profile(scored, BASE, NAMES).isEmpty()


def test_refresh_makes_current_window_the_reference(spark):
    rows = np.vstack([np.random.default_rng(0).normal(0, 1, (150, 5)), np.random.default_rng(1).normal(5, 1, (150, 5))]).tolist()
    scored = frame(spark, rows)
    base = profile.reference_profile(scored, BASE, NAMES)
    asked = spark.createDataFrame([("main", 110 * 1_000_000), ("main", 250 * 1_000_000)], "stream_id string, ts_us long")
    table = profile.refreshed_profiles(scored, base, asked, BASE, NAMES)
    assert {(r.profile_id, r.from_u, r.to_u) for r in table.collect()} == {(0, 0, 150), (1, 150, None)}
    got = profile.windowed_distances(profile.pane_stats(scored, table, BASE, NAMES), table, BASE)
    psi = {(r.u, r.feature): r.psi for r in got.collect()}
    data = np.array(rows)
    assert psi[150, "f1"] == pytest.approx(psi_frozen(data[:100, 0], data[200:250, 0]))
    assert psi[175, "f1"] == pytest.approx(psi_frozen(data[200:250, 0], data[225:275, 0]))
    assert psi[175, "f1"] < 1 < psi[150, "f1"]


def test_adaptive_window_detects_a_moved_mean_and_forgets():
    rng = np.random.default_rng(0)
    window = adwin.AdaptiveWindow(0.002)
    flags = []
    for part, mean in ((100, 0.3), (100, 0.8)):
        for _ in range(part):
            x = rng.normal(mean, 0.05, 32)
            flags.append(window.add(32.0, float(x.mean()), float(((x - x.mean()) ** 2).sum())))
    assert not any(flags[:100]) and any(flags[100:110])
    n, mean, _ = window.total
    assert abs(mean - 0.8) < 0.02 and n < 110 * 32
    assert sum(len(level) for level in window.levels) < 60


def test_run_with_several_streams_keeps_them_apart(spark, sf):
    from pyspark.sql import functions as F

    from tidegauge.catalog import inputs as I

    cfg = replace(
        I.SMALL_CONFIG, model=ModelConfig(kind="zscore", warmup_events=60),
        drift=replace(I.SMALL_CONFIG.drift, reference_events=80, window_size=40, interval=20, min_samples=20),
    )
    one = I.events(spark, sf).filter(F.col("entity_id").cast("long") % 2 == 0)
    other = I.events(spark, sf).filter(F.col("entity_id").cast("long") % 2 == 1).withColumn("stream_id", F.lit("other"))
    both = ScoringRun(one.unionByName(other), cfg)
    alone = ScoringRun(other, cfg)
    pick = lambda df: sorted((r.t, round(r.threshold, 9)) for r in df.filter("stream_id = 'other'").collect())
    assert pick(both.thresholds) == pick(alone.thresholds) and pick(both.thresholds)
    short = ScoringRun(one.limit(50), cfg)
    assert short.scored.isEmpty() and short.output.filter("status = 'warming_up'").count() == 50
    assert isinstance(EngineConfig(FeatureConfig(), ModelConfig(), DriftConfig(), ControlConfig()).dedupe, bool)


def test_window_report_sorts_no_rows(spark):
    """Windows are hash aggregates, whose memory follows their number and not that of the rows."""
    rows = spark.range(1, 401).selectExpr("id AS idx", "id * 10 AS ts_us", "cast(id % 7 AS double) AS x", "0 AS label")
    found = windows.window_psi(rows, ["x"], None, "label", 100, 50, 50)
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    assert sorted((r.window_id, r.start_us, r.end_us) for r in found.collect()) == [(w, 1010 + 500 * w, 1500 + 500 * w) for w in range(6)]


def test_trailing_alerts_by_brute_force(spark):
    rng = np.random.default_rng(11)
    at = sorted(int(x) for x in rng.integers(0, 60, 300) * 1_000_000 + rng.integers(0, 2, 300))
    got = windows.trailing_alert_rate(spark.createDataFrame([("a", t) for t in at], "k string, ts_us long"), ["k"], 3).collect()
    assert sorted((r.ts_us, r.alerts_now, r.alerts_trailing) for r in got) == [(t, at.count(t), sum(t - 3_000_000 <= x <= t for x in at)) for t in sorted(set(at))]


def test_trailing_alerts_use_running_totals(spark):
    rows = windows.trailing_alert_rate(spark.createDataFrame([("a", 1)], "k string, ts_us long"), ["k"], 3)
    assert "RangeFrame, unboundedpreceding$()" in rows._jdf.queryExecution().toString()
