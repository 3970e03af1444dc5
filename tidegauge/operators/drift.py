"""Drift evaluations: fusion of distances, adaptive limits, warning and critical states."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import SCORE, DriftConfig
from tidegauge.functions.scalar import damped
from tidegauge.operators.folding import chunked_fold

# Weights of the per-feature fusion and the vote share that keeps a state.
FUSION_PSI, FUSION_KS, FUSION_SHIFT = 0.55, 0.30, 0.15
KEEP_VOTE = 0.8
WARNING_FUSION = 0.9
#: Evaluations of one stream that are folded in one task; longer than a calibration history, so that chunks forget.
EVALUATION_CHUNK = 10_000


def evaluation_rows(distances: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per evaluation: arrays over features in order, and the score's own distances."""

    def of(feature: str, column: str) -> Column:
        return F.max(F.when(F.col("feature") == feature, F.col(column)))

    arrays = [
        F.array(*[of(f, c) for f in features]).alias(n)
        for n, c in (("psi", "psi"), ("ks", "ks"), ("ks_critical", "ks_critical"), ("mean_shift_z", "mean_shift_z"))
    ]
    return distances.groupBy("stream_id", "u", "t", "profile_id").agg(
        *arrays,
        of(SCORE, "psi").alias("score_psi"),
        of(SCORE, "ks").alias("score_ks"),
        of(SCORE, "ks_critical").alias("score_ks_critical"),
    )


def fused_at_fixed_limits(distances: DataFrame, cfg: DriftConfig, n_features: int) -> DataFrame:
    """Drift score, components and vote share with the configured limits; expressions only."""
    cap = cfg.norm_cap
    is_score = F.col("feature") == SCORE
    psi_limit = F.when(is_score, F.lit(cfg.pred_psi)).otherwise(F.lit(cfg.feature_psi))
    psi_norm = damped(F.col("psi") / F.greatest(F.lit(1e-9), psi_limit), cap)
    ks_norm = damped(F.col("ks") / F.greatest(F.lit(1e-9), F.col("ks_critical")), cap)
    shift_norm = damped(F.col("mean_shift_z") / F.lit(max(1e-9, cfg.mean_shift_z)), cap)
    fusion = FUSION_PSI * psi_norm + FUSION_KS * ks_norm + FUSION_SHIFT * shift_norm
    rows = distances.select(
        "stream_id", "u", "t", is_score.alias("is_score"), psi_norm.alias("psi_norm"),
        ks_norm.alias("ks_norm"), fusion.alias("fusion"),
    )

    def over(feature_rows: bool, c: str) -> Column:
        keep = ~F.col("is_score") if feature_rows else F.col("is_score")
        return F.coalesce(F.avg(F.when(keep, F.col(c))), F.lit(0.0))

    votes = F.count_if(~F.col("is_score") & (F.col("fusion") >= cfg.feature_alert_score))
    out = rows.groupBy("stream_id", "u", "t").agg(
        (F.lit(cfg.weight_psi) * over(True, "psi_norm")).alias("psi_component"),
        (F.lit(cfg.weight_ks) * over(True, "ks_norm")).alias("ks_component"),
        (F.lit(cfg.weight_pred) * (0.5 * over(False, "psi_norm") + 0.5 * over(False, "ks_norm"))).alias(
            "prediction_component"
        ),
        (votes / F.lit(float(max(1, n_features)))).alias("vote_ratio"),
        over(True, "fusion").alias("mean_fusion"),
    )
    total = F.col("psi_component") + F.col("ks_component") + F.col("prediction_component")
    return out.withColumn("drift_score", total).withColumn(
        "drift_fixed_active",
        (F.col("drift_score") >= cfg.fixed_score_threshold) & (F.col("vote_ratio") >= cfg.critical_vote),
    )


class _History:
    """Last ``size`` rows of calibration values, one column per tracked limit, also kept in order."""

    def __init__(self, size: int, width: int) -> None:
        self.size, self.width, self.seen = size, width, 0
        self.rows = np.empty((0, width))
        self.sorted = np.empty((width, 0))

    def _room(self) -> None:
        n = min(self.size, max(64, 2 * len(self.rows)))
        rows, ordered = np.empty((n, self.width)), np.empty((self.width, n))
        rows[: len(self.rows)], ordered[:, : len(self.rows)] = self.rows, self.sorted
        self.rows, self.sorted = rows, ordered

    def __len__(self) -> int:
        return min(self.seen, self.size)

    def add(self, row: np.ndarray) -> None:
        n, slot = len(self), self.seen % self.size
        if n == len(self.rows) < self.size:
            self._room()
        gone = self.rows[slot].copy() if n == self.size else None
        for i, x in enumerate(row):
            column = self.sorted[i]
            if gone is None:
                at = int(np.searchsorted(column[:n], x))
                column[at + 1 : n + 1] = column[at:n].copy()
            else:
                out = int(np.searchsorted(column, gone[i]))
                at = int(np.searchsorted(column, x))
                if at > out:
                    at -= 1
                    column[out:at] = column[out + 1 : at + 1].copy()
                else:
                    column[at + 1 : out + 1] = column[at:out].copy()
            column[at] = x
        self.rows[slot] = row
        self.seen += 1

    def quantile(self, q: float) -> np.ndarray:
        """Linear-interpolated quantile of each column, read off the order."""
        n = len(self)
        at = q * (n - 1)
        low = int(at)
        a, b = self.sorted[:, low], self.sorted[:, min(low + 1, n - 1)]
        return a + (b - a) * (at - low)

    def spread(self) -> np.ndarray:
        return self.rows[: len(self)].std(axis=0)

    def dump(self) -> list[float]:
        """Rows from the oldest on."""
        n, first = len(self), self.seen % self.size if self.seen > self.size else 0
        return np.roll(self.rows[:n], -first, axis=0).ravel().tolist()

    def load(self, values: list[float], seen: int) -> None:
        rows = np.asarray(values, dtype=float).reshape(-1, self.width)
        self.seen = seen
        self.rows = np.roll(rows, seen % self.size if seen > self.size else 0, axis=0)
        self.sorted = np.sort(rows, axis=0).T.copy()


EVALUATION_SCHEMA = (
    "stream_id string, u long, t long, profile_id int, drift_score double, drift_threshold double, "
    "psi_component double, ks_component double, prediction_component double, vote_ratio double, "
    "mean_fusion double, drift_fixed_active boolean, drift_warning_active boolean, drift_active boolean, "
    "adwin_detected boolean, psi array<double>, ks array<double>, mean_shift_z array<double>, "
    "psi_limits array<double>, ks_limits array<double>"
)


def _norm(ratio: np.ndarray, cap: float) -> np.ndarray:
    return np.minimum(np.log1p(np.maximum(0.0, ratio)), cap)


def _mean(x: np.ndarray) -> float:
    return float(np.mean(x)) if x.size else 0.0


class DriftFold:
    """Warning and critical state of one stream, advanced by evaluation rows in order.

    Holds calibration histories of bounded length, two run lengths and two flags, which can be written
    down between chunks and micro-batches.
    """

    FIELDS = {
        "learned": "long", "scores": "array<double>", "psi_rows": "array<double>", "ks_rows": "array<double>",
        "psi_limits": "array<double>", "ks_limits": "array<double>", "warning_run": "long", "critical_run": "long",
        "warning": "boolean", "critical": "boolean", "last_alert": "long",
    }

    def __init__(self, cfg: DriftConfig) -> None:
        self.cfg = cfg
        self.scores = _History(cfg.history_evals, 1)
        self.limits: dict[str, np.ndarray] = {}
        self.history: dict[str, _History] = {}
        self.warning_run = self.critical_run = 0
        self.warning = self.critical = False
        self.last_alert = -(10**9)

    def dump(self) -> dict:
        def rows(name: str) -> list[float]:
            return self.history[name].dump() if self.limits else []

        def limits(name: str) -> list[float]:
            return self.limits[name].tolist() if self.limits else []

        return {
            "learned": self.scores.seen, "scores": self.scores.dump(), "psi_rows": rows("psi"), "ks_rows": rows("ks"),
            "psi_limits": limits("psi"), "ks_limits": limits("ks"), "warning_run": self.warning_run,
            "critical_run": self.critical_run, "warning": self.warning, "critical": self.critical, "last_alert": self.last_alert,
        }

    def load(self, state: dict) -> None:
        seen = int(state["learned"])
        self.scores.load(state["scores"], seen)
        self.limits = {n: np.asarray(state[f"{n}_limits"], dtype=float) for n in ("psi", "ks") if len(state[f"{n}_limits"])}
        self.history = {n: _History(self.cfg.history_evals, len(v)) for n, v in self.limits.items()}
        for n, h in self.history.items():
            h.load(state[f"{n}_rows"], seen)
        self.warning_run, self.critical_run = int(state["warning_run"]), int(state["critical_run"])
        self.warning, self.critical = bool(state["warning"]), bool(state["critical"])
        self.last_alert = int(state["last_alert"])

    def _learn(self, score: float, psi: np.ndarray, ks_ratio: np.ndarray) -> None:
        cfg = self.cfg
        self.scores.add(np.array([score]))
        for name, row, floor in (("psi", psi, cfg.feature_psi), ("ks", ks_ratio, 1.0)):
            self.history[name].add(row)
            past = self.history[name]
            if len(past) >= cfg.baseline_min_evals:
                self.limits[name] = np.maximum(floor, past.quantile(cfg.adaptive_quantile) + cfg.feature_threshold_k * past.spread())

    def _limit(self) -> float:
        cfg = self.cfg
        if cfg.threshold_method != "adaptive" or self.scores.seen < cfg.baseline_min_evals:
            return cfg.fixed_score_threshold
        return max(cfg.fixed_score_threshold, float(self.scores.quantile(cfg.adaptive_quantile)[0]))

    def advance(self, row) -> dict:
        cfg = self.cfg
        psi = np.asarray(row.psi, dtype=float)
        ks = np.asarray(row.ks, dtype=float)
        ks_ratio = ks / np.maximum(1e-9, np.asarray(row.ks_critical, dtype=float))
        shift = np.asarray(row.mean_shift_z, dtype=float)
        if not self.limits:
            self.limits = {"psi": np.full(psi.size, cfg.feature_psi), "ks": np.ones(psi.size)}
            self.history = {n: _History(cfg.history_evals, psi.size) for n in self.limits}
        used = {n: v.copy() for n, v in self.limits.items()}
        psi_norm = _norm(psi / np.maximum(1e-9, used["psi"]), cfg.norm_cap)
        ks_norm = _norm(ks_ratio / np.maximum(1e-9, used["ks"]), cfg.norm_cap)
        shift_norm = _norm(shift / max(1e-9, cfg.mean_shift_z), cfg.norm_cap)
        fusion = FUSION_PSI * psi_norm + FUSION_KS * ks_norm + FUSION_SHIFT * shift_norm
        vote = float(np.sum(fusion >= cfg.feature_alert_score)) / max(1, psi.size)
        pred = _norm(
            np.array([row.score_psi / max(1e-9, cfg.pred_psi), row.score_ks / max(1e-9, row.score_ks_critical)]),
            cfg.norm_cap,
        )
        parts = (
            cfg.weight_psi * _mean(psi_norm),
            cfg.weight_ks * _mean(ks_norm),
            cfg.weight_pred * float(0.5 * pred[0] + 0.5 * pred[1]),
        )
        score, limit, mean_fusion = sum(parts), self._limit(), _mean(fusion)

        # Flags are forgotten between evaluations in reference mode, unless there is no gap.
        remembers = cfg.mode == "latched" or cfg.interval <= 1
        was_warning, was_critical = self.warning and remembers, self.critical and remembers
        keep_warning = vote >= cfg.warning_vote * KEEP_VOTE
        if was_warning:
            hit = score >= limit * cfg.warning_exit and keep_warning
        else:
            full = vote >= cfg.warning_vote and mean_fusion >= cfg.feature_alert_score * WARNING_FUSION
            hit = full and score >= limit * cfg.warning_enter
        hit = hit or (bool(row.adwin_detected) and keep_warning)
        self.warning_run = self.warning_run + 1 if hit else 0
        self.warning = self.warning_run >= max(1, cfg.warning_consecutive)

        if was_critical:
            hit = score >= limit * cfg.critical_exit and vote >= cfg.critical_vote * KEEP_VOTE
        else:
            full = vote >= cfg.critical_vote and mean_fusion >= cfg.feature_alert_score
            hit = self.warning and full and score >= limit * cfg.critical_enter
        self.critical_run = self.critical_run + 1 if hit else 0
        ready = self.critical_run >= max(1, cfg.critical_consecutive)
        stays = was_critical and hit
        enters = not stays and ready and row.u - self.last_alert >= cfg.alert_cooldown_events
        if enters:
            self.last_alert = int(row.u)
        self.critical = bool(stays or enters)

        calm = vote <= cfg.warning_vote * KEEP_VOTE and not was_critical
        if calm or len(self.scores) < max(50, cfg.baseline_min_evals * 3):
            self._learn(score, psi, ks_ratio)
        return {
            "stream_id": row.stream_id, "u": row.u, "t": row.t, "profile_id": row.profile_id,
            "drift_score": score, "drift_threshold": limit, "psi_component": parts[0],
            "ks_component": parts[1], "prediction_component": parts[2], "vote_ratio": vote,
            "mean_fusion": mean_fusion,
            "drift_fixed_active": score >= cfg.fixed_score_threshold and vote >= cfg.critical_vote,
            "drift_warning_active": self.warning, "drift_active": self.critical,
            "adwin_detected": bool(row.adwin_detected), "psi": psi, "ks": ks, "mean_shift_z": shift,
            "psi_limits": used["psi"], "ks_limits": used["ks"],
        }

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([self.advance(row) for row in pdf.itertuples(index=False)])


def drift_states(evaluations: DataFrame, cfg: DriftConfig, chunk: int = EVALUATION_CHUNK) -> DataFrame:
    """Adaptive limits and warning / critical states, folded over the evaluation table.

    ``evaluations``: rows of ``evaluation_rows`` with ``adwin_detected``; one row per
    ``cfg.interval`` scored events. ``chunk``: evaluations folded in one task.
    """
    width = max(1, chunk * cfg.interval)
    return chunked_fold(evaluations, ["stream_id"], "u", width, lambda: DriftFold(cfg), EVALUATION_SCHEMA, "drift")
