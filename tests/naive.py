"""Slow, independent implementations used as references in tests."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from tidegauge.config import FEATURES


def naive_features(rows, window_s, cap):
    """rows: (event_id, ts_us, entity, amount, merchant, country), fed in event order."""
    state, out = {}, {}
    for event_id, ts, entity, amount, merchant, country in sorted(rows, key=lambda r: (r[1], r[0])):
        seen = state.setdefault(entity, deque(maxlen=cap))
        seen.append((ts, amount, merchant, country))
        while seen[0][0] < ts - window_s * 1_000_000:
            seen.popleft()
        prior = list(seen)[:-1]
        values = dict.fromkeys(FEATURES, 0.0)
        if prior:
            amounts = [p[1] for p in prior]
            mean = sum(amounts) / len(amounts)
            values["cnt_5m"] = float(len(prior))
            values["amt_sum_5m"] = sum(amounts)
            values["amt_mean_5m"] = mean
            values["amt_std_5m"] = math.sqrt(sum((a - mean) ** 2 for a in amounts) / len(amounts))
            values["uniq_merchant_5m"] = float(len({p[2] for p in prior}))
            values["uniq_country_5m"] = float(len({p[3] for p in prior}))
            values["rate_per_min"] = len(prior) / max(1.0, (ts - prior[0][0]) / 1e6) * 60.0
        out[event_id] = tuple(round(values[f], 6) for f in FEATURES)
    return out


def edges_of(ref):
    q = np.quantile(ref, np.linspace(0, 1, 11))
    q[0], q[-1] = np.min(ref) - 1e-9, np.max(ref) + 1e-9
    return q


def shares(x, edges):
    counts = np.histogram(x, bins=edges)[0]
    return counts / max(1, counts.sum())


def psi_frozen(ref, cur):
    edges = edges_of(ref)
    r, c = (np.clip(shares(x, edges), 1e-6, 1.0) for x in (ref, cur))
    return float(np.sum((c - r) * np.log(c / r)))


def ks_frozen(ref, cur):
    edges = edges_of(ref)
    r = np.clip(shares(ref, edges), 1e-6, 1.0)
    return float(np.max(np.abs(np.cumsum(r) - np.cumsum(shares(cur, edges)))))


class NaiveController:
    """Per-event threshold controller over full score lists."""

    def __init__(self, cfg):
        self.cfg, self.thr, self.last, self.n, self.scores = cfg, cfg.initial_threshold, None, 0, []

    def update(self, score, ts, drift=False):
        cfg = self.cfg
        self.n += 1
        if math.isfinite(score):
            self.scores.append(score)
        window = self.scores[-cfg.history :]
        blocked = (
            not cfg.enabled
            or (drift and not cfg.adapt_during_drift)
            or (self.last is not None and ts - self.last < cfg.cooldown_seconds)
            or len(window) < cfg.min_history
            or self.n % cfg.interval != 0
        )
        if blocked:
            return self.thr
        new = float(np.clip(np.quantile(window, 1 - cfg.target_rate), cfg.min_threshold, cfg.max_threshold))
        new = float(np.clip(new, self.thr - cfg.max_step, self.thr + cfg.max_step))
        if cfg.rate_feedback:
            rate = float(np.mean(np.asarray(window) >= self.thr))
            if rate > cfg.target_rate + cfg.tolerance and new < self.thr:
                new = self.thr + cfg.max_step
            elif rate < cfg.target_rate - cfg.tolerance and new > self.thr:
                new = self.thr - cfg.max_step
        if new != self.thr:
            self.thr, self.last = new, ts
        return self.thr
