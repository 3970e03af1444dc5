"""Guarded threshold control: parallel tick quantiles, a fold over ticks, operator controls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import ControlConfig
from tidegauge.functions.scalar import hash_sampled, is_finite
from tidegauge.operators.folding import chunked_fold
from tidegauge.operators.ordering import asof_join, running_totals, with_halo
from tidegauge.session import small

TICK_CHUNK = 20_000
#: Ticks of one stream whose thresholds are followed in one task.
PATH_CHUNK = 50_000
CONTROL_CHUNK_US = 600_000_000
CONTROL_SALTS = 16

# Operator actions.
FREEZE, UNFREEZE, REFRESH = "freeze_adaptation", "unfreeze_adaptation", "refresh_reference"

TICK_SCHEMA = (
    "stream_id string, t long, ts_us long, event_id string, n_history long, proposal double, "
    "over_mark double, under_mark double"
)


def _rank_marks(window: np.ndarray, upper: float, lower: float) -> tuple[float, float]:
    """Two order statistics that decide the rate tests for any threshold.

    The share of scores at or above a threshold exceeds ``upper`` iff the first mark is at or
    above the threshold; it is under ``lower`` iff the second mark is below the threshold.
    """
    n = len(window)
    descending = np.sort(window)[::-1]
    counts = np.arange(1, n + 1) / n
    above = int(np.searchsorted(counts, upper, side="right"))
    over = descending[above] if above < n else -math.inf
    enough = int(np.searchsorted(counts, lower, side="left"))
    if lower <= 0.0:
        under = math.inf
    else:
        under = descending[enough] if enough < n else -math.inf
    return float(over), float(under)


def tick_quantiles(scored: DataFrame, cfg: ControlConfig) -> DataFrame:
    """Proposed threshold at every tick from the trailing score history.

    Positions are cut into chunks with a halo of one history, so all ticks are computed in
    parallel even for a single stream. Non-finite scores take up no history.
    """
    rows = scored.select("stream_id", "t", "ts_us", "event_id", "score")
    finite = is_finite(F.col("score"))
    if rows.filter(~finite).isEmpty():
        rows = rows.withColumn("f", F.col("t"))
    else:
        rows = running_totals(rows, ["stream_id"], ["t"], {"f": finite.cast("long")})
    size = max(TICK_CHUNK, cfg.history)
    chunks = with_halo(rows, "f", size, cfg.history)
    interval, history, need = max(1, cfg.interval), cfg.history, max(1, cfg.min_history)
    level = max(0.0, min(1.0, 1.0 - cfg.target_rate))
    upper, lower = cfg.target_rate + cfg.tolerance, cfg.target_rate - cfg.tolerance

    def quantiles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        values = pdf["score"].to_numpy(dtype=float)
        ok = np.isfinite(values)
        ends = np.cumsum(ok)
        scores = values[ok]
        ticks = np.flatnonzero(pdf["_core"].to_numpy() & (pdf["t"].to_numpy() % interval == 0))
        known = np.minimum(pdf["f"].to_numpy()[ticks], history)
        proposal = np.full(len(ticks), np.nan)
        marks = np.full((len(ticks), 2), np.nan)
        complete = ends[ticks] >= known  # not so where a stream's tail was cut: such ticks are of no interest
        whole = complete & (known == history)
        if whole.any():
            views = np.lib.stride_tricks.sliding_window_view(scores, history)
            starts = ends[ticks[whole]] - history
            for part in np.array_split(np.arange(len(starts)), max(1, len(starts) * history // 4_000_000)):
                at = np.flatnonzero(whole)[part]
                proposal[at] = np.quantile(views[starts[part]], level, axis=1)
        for i, (tick, n) in enumerate(zip(ticks, known, strict=True)):
            window = scores[ends[tick] - n : ends[tick]]
            if n < need or not complete[i]:
                continue
            if not whole[i]:
                proposal[i] = np.quantile(window, level)
            if cfg.rate_feedback:
                marks[i] = _rank_marks(window, upper, lower)
        out = pdf.iloc[ticks][["stream_id", "t", "ts_us", "event_id"]]
        return out.assign(n_history=known, proposal=proposal, over_mark=marks[:, 0], under_mark=marks[:, 1])

    return chunks.groupBy("stream_id", "_chunk").applyInPandas(quantiles, TICK_SCHEMA)


CONTROL_SCHEMA = (
    "stream_id string, t long, ts_us long, event_id string, proposal double, old_threshold double, "
    "threshold double, last_change_us long, changed boolean, bounds_limited boolean, "
    "step_limited boolean, feedback_blocked boolean, audit_due boolean"
)
CONTROL_COLUMNS = [field.split()[0] for field in CONTROL_SCHEMA.split(", ")]


class ThresholdFold:
    """Threshold of one stream, advanced by ticks in order; the state is four numbers."""

    FIELDS = {"threshold": "double", "changed_us": "long", "logged": "double", "logged_us": "long"}

    def __init__(self, cfg: ControlConfig) -> None:
        self.cfg = cfg
        self.threshold, self.changed_us = cfg.initial_threshold, 0
        self.logged, self.logged_us = cfg.initial_threshold, 0

    def dump(self) -> dict:
        return {f: getattr(self, f) for f in self.FIELDS}

    def load(self, state: dict) -> None:
        self.threshold, self.changed_us = float(state["threshold"]), int(state["changed_us"])
        self.logged, self.logged_us = float(state["logged"]), int(state["logged_us"])

    def advance(self, row) -> tuple:
        cfg, old = self.cfg, self.threshold
        bounded = stepped = blocked = audit = False
        cooling = self.changed_us and (row.ts_us - self.changed_us) / 1e6 < cfg.cooldown_seconds
        open_ = cfg.enabled and not row.frozen and (cfg.adapt_during_drift or not row.drift_active)
        if open_ and not cooling and row.n_history >= max(1, cfg.min_history):
            target = min(cfg.max_threshold, max(cfg.min_threshold, row.proposal))
            bounded = target != row.proposal
            if abs(target - old) > cfg.max_step:
                target = old + math.copysign(cfg.max_step, target - old)
                stepped = True
            if cfg.rate_feedback and row.over_mark >= old and target < old:
                target, blocked = old + cfg.max_step, True
            elif cfg.rate_feedback and row.under_mark < old and target > old:
                target, blocked = old - cfg.max_step, True
            if target != old:
                self.threshold, self.changed_us = target, int(row.ts_us)
                waited = (row.ts_us - self.logged_us) / 1e6 >= cfg.audit_cooldown_seconds
                audit = abs(target - self.logged) >= cfg.audit_min_delta or waited
                if audit:
                    self.logged, self.logged_us = target, int(row.ts_us)
        return (
            row.stream_id, row.t, row.ts_us, row.event_id, row.proposal, old, self.threshold, self.changed_us,
            self.threshold != old, bounded, stepped, blocked, audit,
        )

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([self.advance(row) for row in pdf.itertuples(index=False)], columns=CONTROL_COLUMNS)


def threshold_path(ticks: DataFrame, cfg: ControlConfig, chunk: int = PATH_CHUNK) -> DataFrame:
    """Threshold after every tick: ticks (with ``drift_active`` and ``frozen``) folded per stream, one row per
    ``cfg.interval`` events. A tick moves the threshold towards its proposal, so chunks of ``chunk`` ticks forget
    where they started and run in parallel."""
    width = max(1, chunk * max(1, cfg.interval))
    return chunked_fold(ticks, ["stream_id"], "t", width, lambda: ThresholdFold(cfg), CONTROL_SCHEMA, "thresholds")


def with_threshold(scored: DataFrame, path: DataFrame, cfg: ControlConfig) -> DataFrame:
    """Events with the threshold in force: an equi-join on the tick, initial value before the first."""
    interval = max(1, cfg.interval)
    steps = path.select("stream_id", F.floor(F.col("t") / interval).cast("long").alias("tick_id"), "threshold")
    rows = scored.withColumn("tick_id", F.floor(F.col("t") / interval).cast("long"))
    joined = rows.join(steps, ["stream_id", "tick_id"], "left")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(cfg.initial_threshold))).drop("tick_id")


def skip_reasons(scored: DataFrame, path: DataFrame, cfg: ControlConfig) -> DataFrame:
    """Events with the reason the controller left the threshold alone, null where it looked.

    ``scored`` carries ``drift_active`` and ``frozen``. The change time that counts at an event is
    the one before it, so a tick looks at the previous tick's outcome.
    """
    interval = max(1, cfg.interval)
    before = F.floor((F.col("t") - 1) / interval).cast("long")
    steps = path.select(
        "stream_id", F.floor(F.col("t") / interval).cast("long").alias("_before"),
        F.col("last_change_us").alias("_changed_us"),
    )
    rows = scored.withColumn("_before", before).join(steps, ["stream_id", "_before"], "left")
    changed = F.coalesce("_changed_us", F.lit(0))
    reason = F.lit(None).cast("string")
    if cfg.enabled:
        cooling = (changed != 0) & ((F.col("ts_us") - changed) / 1e6 < cfg.cooldown_seconds)
        in_drift = F.col("drift_active") & F.lit(not cfg.adapt_during_drift)
        reason = (
            F.when(F.col("frozen"), "frozen")
            .when(in_drift, "drift")
            .when(cooling, "cooldown")
            .when(F.least(F.col("t"), F.lit(cfg.history)) < max(1, cfg.min_history), "history")
            .when(F.col("t") % interval != 0, "interval")
        )
    else:
        reason = F.lit("disabled")
    return rows.withColumn("skip_reason", reason).drop("_before", "_changed_us")


def control_counters(reasons: DataFrame, path: DataFrame) -> DataFrame:
    """Skip and limit counters per stream."""

    def skipped(name: str) -> Column:
        return F.count_if(F.col("skip_reason") == name).alias(f"skipped_{name}")

    skips = reasons.groupBy("stream_id").agg(
        skipped("drift"), skipped("cooldown"), skipped("history"), skipped("interval"),
        F.count_if(F.col("skip_reason") == "frozen").alias("frozen_events"),
    )
    limits = path.groupBy("stream_id").agg(
        F.count_if("changed").alias("updates_applied"), F.count_if("step_limited").alias("step_limited"),
        F.count_if("bounds_limited").alias("bounds_limited"), F.count_if("feedback_blocked").alias("feedback_blocked"),
    )
    return skips.join(limits, "stream_id", "left").na.fill(0)


def audit_rows(path: DataFrame, cfg: ControlConfig) -> DataFrame:
    """Sampled log of notable threshold changes."""
    due = path.filter("changed AND audit_due").filter(hash_sampled(F.col("event_id"), cfg.audit_sample_rate))
    return due.select(
        "stream_id", "t", "ts_us", "event_id", "old_threshold", F.col("threshold").alias("new_threshold"),
        F.lit("controller").alias("actor"), F.lit("target_anomaly_rate_control").alias("reason"),
    )


def circuit_openings(lags: DataFrame, releases: DataFrame, cfg: ControlConfig) -> DataFrame:
    """First event over the lag limit in each stretch between releases.

    ``lags``: stream_id, ts_us, event_id, lag_s. ``releases``: stream_id, ts_us of unfreezes.
    """
    late = lags.filter(F.col("lag_s") > cfg.lag_limit_seconds)
    marks = releases.select("stream_id", "ts_us", F.lit(True).alias("released"))
    tagged = asof_join(late.select("stream_id", "ts_us", "event_id", "lag_s"), marks, ["stream_id"], "ts_us", CONTROL_CHUNK_US, salts=CONTROL_SALTS)
    first = tagged.groupBy("stream_id", "right_ts_us").agg(
        F.min(F.struct("ts_us", "event_id", "lag_s")).alias("_first")
    )
    return first.select("stream_id", "_first.*")


def latest_action(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Rows with the last freeze or unfreeze at or before them, and whether that means frozen."""
    switches = controls.filter(F.col("action").isin(FREEZE, UNFREEZE)).select("stream_id", "ts_us", "action")
    joined = asof_join(rows, switches, ["stream_id"], "ts_us", CONTROL_CHUNK_US, "action", CONTROL_SALTS)
    frozen = F.coalesce(F.col("action") == FREEZE, F.lit(False))
    return joined.withColumn("frozen", frozen).withColumnRenamed("action", "last_action").drop("right_ts_us")


def control_audit(controls: DataFrame) -> DataFrame:
    """Operator actions with default actor and reason."""
    default_reason = (
        F.when(F.col("action") == FREEZE, "manual_freeze")
        .when(F.col("action") == UNFREEZE, "manual_unfreeze")
        .otherwise("manual_reference_refresh")
    )
    return controls.select(
        "stream_id", "ts_us", "action", F.coalesce("actor", F.lit("unknown")).alias("actor"),
        F.coalesce("reason", default_reason).alias("reason"),
    )


def recent_rate(judged: DataFrame, cfg: ControlConfig) -> DataFrame:
    """Share of the last ``history`` finite scores at or above the latest threshold, per stream."""
    rows = judged.filter(is_finite(F.col("score")))
    ends = rows.groupBy("stream_id").agg(F.max("t").alias("_last"), F.max_by("threshold", "t").alias("_threshold"))
    recent = rows.select("stream_id", "t", "score").join(small(ends), "stream_id")
    recent = recent.filter(F.col("t") > F.col("_last") - cfg.history)
    return recent.groupBy("stream_id").agg(
        F.max("_threshold").alias("threshold"), F.avg((F.col("score") >= F.col("_threshold")).cast("double")).alias("recent_rate")
    )
