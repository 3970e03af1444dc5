"""The scoring job: events -> features -> scores -> drift evaluations -> thresholds -> alerts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import EngineConfig
from tidegauge.operators import adwin, control, drift, profile
from tidegauge.operators.alerts import alerts_of, circuit_alerts
from tidegauge.operators.dedupe import duplicate_counts, first_per_id, opening_events
from tidegauge.operators.features import entity_features
from tidegauge.operators.models import AnomalyModel, model_for
from tidegauge.operators.ordering import event_index, exact_quantiles
from tidegauge.session import stage

STATE = ("drift_score", "drift_threshold", "vote_ratio", "psi_component", "ks_component", "prediction_component")


class ScoringRun:
    """Tables of one batch scoring run, each computed on first use.

    Feature rows are written once to the staging folder and everything after reads that table
    with the columns it needs; evaluations and ticks, which are summaries, are staged as well.

    ``controls``: operator actions (stream_id, ts_us, action, actor, reason). ``lags``: processing
    lag per event (stream_id, ts_us, event_id, lag_s) for the circuit breaker.
    """

    def __init__(
        self,
        events: DataFrame,
        cfg: EngineConfig,
        controls: DataFrame | None = None,
        lags: DataFrame | None = None,
        model: AnomalyModel | None = None,
    ) -> None:
        self.events, self.cfg, self.controls, self.lags = events, cfg, controls, lags
        self.custom_model = model

    @property
    def names(self) -> tuple[str, ...]:
        return self.cfg.features.enabled

    @cached_property
    def model(self):
        """Model of every stream that finishes its warm-up, fitted on the warm-up rows only."""
        warmup = self.cfg.model.warmup_events
        opening = opening_events(self.events, warmup, self.cfg.dedupe)
        warm = stage(entity_features(opening, self.cfg.features), "warmup")
        ready = warm.filter(F.col("idx") == warmup).select("stream_id")
        model = self.custom_model or model_for(self.cfg.model)
        return model.fit(warm.join(ready, "stream_id", "left_semi"), self.names)

    @cached_property
    def features(self) -> DataFrame:
        """Deduplicated events with their position, features and, after the warm-up, scores.

        One pass writes the table everything after reads from.
        """
        warmup = self.cfg.model.warmup_events
        events = first_per_id(self.events) if self.cfg.dedupe else self.events
        rows = self.model.transform(entity_features(event_index(events, plan_from=self.events), self.cfg.features))
        scored = {c: F.when(F.col("idx") > warmup, F.col(c)) for c in ("raw_score", "score")}
        return stage(rows.withColumns(scored), "features")

    @cached_property
    def scored(self) -> DataFrame:
        """Rows after the warm-up with position ``t`` among scored rows, raw score and score."""
        rows = self.features.filter(F.col("score").isNotNull())
        return rows.withColumn("t", F.col("idx") - self.cfg.model.warmup_events)

    @cached_property
    def warming_up(self) -> DataFrame:
        """Rows without a score: the warm-up, and streams that never finish it."""
        return self.features.filter(F.col("score").isNull())

    @cached_property
    def profile(self) -> DataFrame:
        cfg = self.cfg.drift
        base = stage(profile.reference_profile(self.scored, cfg, self.names), "profile")
        if self.controls is None:
            return base
        asked = self.controls.filter(F.col("action") == control.REFRESH)
        return stage(profile.refreshed_profiles(self.scored, base, asked, cfg, self.names), "profile")

    @cached_property
    def distances(self) -> DataFrame:
        """Distances per (stream, evaluation, feature)."""
        panes = profile.pane_stats(self.scored, self.profile, self.cfg.drift, self.names)
        return stage(profile.windowed_distances(panes, self.profile, self.cfg.drift), "distances")

    @cached_property
    def change_flags(self) -> DataFrame:
        cfg = self.cfg.drift
        blocks = adwin.score_blocks(self.scored, cfg.reference_events, cfg.adwin_clock)
        return adwin.change_flags(blocks, cfg.adwin_delta)

    @cached_property
    def evaluations(self) -> DataFrame:
        """Drift states, one row per evaluation, with time and label of the evaluated event."""
        cfg = self.cfg.drift
        rows = drift.evaluation_rows(self.distances, self.names)
        if cfg.adwin_enabled:
            flags = self.change_flags.select("stream_id", "t", "adwin_detected")
            rows = rows.join(flags, ["stream_id", "t"], "left").na.fill(False, ["adwin_detected"])
        else:
            rows = rows.withColumn("adwin_detected", F.lit(False))
        states = drift.drift_states(rows, cfg)
        at = self.scored.filter((F.col("t") - cfg.reference_events) % cfg.interval == 0)
        at = at.select("stream_id", "t", "ts_us", "event_id", "drift_tag")
        return stage(states.join(at, ["stream_id", "t"]), "evaluations")

    @cached_property
    def openings(self) -> DataFrame | None:
        """Lag circuit openings."""
        if self.lags is None:
            return None
        releases = self.switches.filter(F.col("action") == control.UNFREEZE) if self.controls is not None else (
            self.lags.select("stream_id", "ts_us").limit(0)
        )
        return control.circuit_openings(self.lags, releases.select("stream_id", "ts_us"), self.cfg.control)

    @property
    def switches(self) -> DataFrame:
        return self.controls.select("stream_id", "ts_us", "action")

    def _with_controls(self, rows: DataFrame) -> DataFrame:
        """Rows with ``frozen``; a circuit opening freezes from the instant after its event."""
        if self.controls is None and self.lags is None:
            return rows.withColumn("frozen", F.lit(False))
        actions = self.switches if self.controls is not None else None
        if self.openings is not None:
            opened = self.openings.select(
                "stream_id", (F.col("ts_us") + 1).alias("ts_us"), F.lit(control.FREEZE).alias("action")
            )
            actions = opened if actions is None else actions.unionByName(opened)
        return control.latest_action(rows, actions).drop("last_action")

    def _with_drift_flag(self, rows: DataFrame) -> DataFrame:
        """Rows with the drift flag the controller sees at them."""
        cfg = self.cfg.drift
        flags = self.evaluations.select("stream_id", F.col("u").alias("_u"), "drift_active")
        u = F.col("t") - cfg.reference_events
        at = F.floor(u / cfg.interval) * cfg.interval if cfg.mode == "latched" else u
        joined = rows.withColumn("_u", at.cast("long")).join(flags, ["stream_id", "_u"], "left")
        return joined.drop("_u").na.fill(False, ["drift_active"])

    @cached_property
    def ticks(self) -> DataFrame:
        ticks = control.tick_quantiles(self.scored, self.cfg.control)
        return stage(self._with_controls(self._with_drift_flag(ticks)), "ticks")

    @cached_property
    def thresholds(self) -> DataFrame:
        """Threshold after every controller tick."""
        return stage(control.threshold_path(self.ticks, self.cfg.control), "thresholds")

    @cached_property
    def judged(self) -> DataFrame:
        """Scored rows with the threshold in force, the alert flag and the latest drift state."""
        cfg = self.cfg.drift
        rows = control.with_threshold(self.scored, self.thresholds, self.cfg.control)
        latest = self.evaluations.select(
            "stream_id", F.col("u").alias("_u"), *STATE,
            *[F.col(c).alias(f"_{c}") for c in ("drift_active", "drift_fixed_active", "drift_warning_active")],
        )
        u = F.col("t") - cfg.reference_events
        rows = rows.withColumn("_u", (F.floor(u / cfg.interval) * cfg.interval).cast("long"))
        rows = rows.join(latest, ["stream_id", "_u"], "left")
        evaluated = (F.col("_u") == u) & F.col("drift_score").isNotNull()
        shown = F.lit(True) if cfg.mode == "latched" else evaluated
        flags = {
            c: F.coalesce(F.col(f"_{c}") & shown, F.lit(False))
            for c in ("drift_active", "drift_fixed_active", "drift_warning_active")
        }
        rows = rows.withColumns({"drift_evaluated": evaluated, **flags, **{c: F.coalesce(c, F.lit(0.0)) for c in STATE}})
        rows = rows.withColumn("is_anomaly", F.col("score") >= F.col("threshold"))
        return rows.drop("_u", *[f"_{c}" for c in flags])

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts_of(self.judged)

    @property
    def circuit_alerts(self) -> DataFrame | None:
        return None if self.openings is None else circuit_alerts(self.openings)

    @cached_property
    def audit(self) -> DataFrame:
        return control.audit_rows(self.thresholds, self.cfg.control)

    @cached_property
    def counters(self) -> DataFrame:
        rows = self._with_controls(self._with_drift_flag(self.scored.select("stream_id", "t", "ts_us")))
        reasons = control.skip_reasons(rows, self.thresholds, self.cfg.control)
        return control.control_counters(reasons, self.thresholds)

    @cached_property
    def output(self) -> DataFrame:
        """One row per event: its status and, where scored, everything decided about it."""
        scored = self.judged.withColumn("status", F.lit("scored"))
        waiting = self.warming_up.withColumn("status", F.lit("warming_up"))
        return scored.unionByName(waiting, allowMissingColumns=True)

    def state_summary(
        self, lags: DataFrame | None = None, copies: DataFrame | None = None, controls: DataFrame | None = None
    ) -> DataFrame:
        """Operational state per stream: flags, threshold, recent rate, model readiness and, from the inputs
        that are given, processing lag, duplicates and whether adaptation is frozen and why.

        ``lags``: stream_id, lag_s. ``copies``: stream_id, event_id, one row per arrival. ``controls``:
        operator actions.
        """
        ends = self.judged.groupBy("stream_id").agg(
            F.count(F.lit(1)).alias("scored_events"), F.max_by("drift_active", "t").alias("drift_active"),
            F.max_by("drift_warning_active", "t").alias("drift_warning_active"),
            F.max_by("drift_score", "t").alias("drift_score"), F.max("ts_us").alias("_last_us"),
        )
        out = ends.join(control.recent_rate(self.judged, self.cfg.control), "stream_id")
        out = out.withColumn("model_ready", F.col("scored_events") > 0)
        if lags is not None:
            levels = exact_quantiles(lags, ["stream_id"], "lag_s", {"lag_p50_s": 0.5, "lag_p95_s": 0.95, "lag_max_s": 1.0})
            out = out.join(levels, "stream_id", "left")
        if copies is not None:
            out = out.join(duplicate_counts(copies, ["stream_id"]), "stream_id", "left").na.fill(0, ["duplicates"])
        if controls is not None:
            audit = control.control_audit(controls).filter(F.col("action").isin(control.FREEZE, control.UNFREEZE))
            ended = audit.join(out.select("stream_id", "_last_us"), "stream_id").filter(F.col("ts_us") <= F.col("_last_us"))
            last = ended.groupBy("stream_id").agg(F.max(F.struct("ts_us", "action", "reason")).alias("_act"))
            frozen = F.coalesce(F.col("_act.action") == control.FREEZE, F.lit(False))
            out = out.join(last, "stream_id", "left").withColumns({"frozen": frozen, "freeze_reason": F.when(frozen, F.col("_act.reason"))}).drop("_act")
        return out.drop("_last_us")
