"""Evaluation jobs: windowed drift report, run evaluation, run comparison, replay summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import tag_present, tag_truthy
from tidegauge.operators import ops, quality
from tidegauge.operators.ordering import event_index
from tidegauge.operators.phases import verify_phase_labels
from tidegauge.operators.windows import trailing_threshold, window_psi
from tidegauge.plans.scoring import ScoringRun
from tidegauge.session import stage


def psi_windows(
    indexed: DataFrame,
    features: Sequence[str],
    pred: str | None,
    label: str = "drift_label",
    reference_size: int = 5000,
    window_size: int = 1000,
    step_size: int = 1000,
    fixed_threshold: float = 0.20,
    history: int = 20,
    quantile: float = 0.95,
    by: Sequence[str] = (),
) -> DataFrame:
    """Windows of each stream ``by`` with their PSI, label, and fixed and adaptive alerts."""
    scored = stage(window_psi(indexed, features, pred, label, reference_size, window_size, step_size, by), "windows")
    return trailing_threshold(scored, fixed_threshold, history, quantile, by=by)


def _named(row: DataFrame, detector: str) -> DataFrame:
    return row.withColumn("detector", F.lit(detector))


SEGMENT_FIGURES = ("segments_total", "segments_detected", "avg_latency_s", "avg_latency_windows", "p95_latency_s")


def _with_segments(counts: DataFrame, segments: DataFrame, detector: str, by: Sequence[str]) -> DataFrame:
    """Confusion and segment figures of one detector, per stream; streams without segments count 0."""
    found = _named(quality.segment_summary(segments, by), detector)
    both = _named(counts, detector).join(found, [*by, "detector"], "left")
    return both.na.fill(0, ["segments_total", "segments_detected"]).na.fill(0.0, list(SEGMENT_FIGURES[2:]))


def psi_report(windows: DataFrame, by: Sequence[str] = (), alerts: Sequence[str] = ("alert_fixed", "alert_adaptive")) -> DataFrame:
    """Confusion and detection latency of the alert columns side by side, per stream, with the reduction of
    false alerts against the first one. The detectors are keys of one pass over the windows."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("detector"), F.col(a).alias("alert")) for a in alerts]))
    rows = windows.select(*by, "window_id", "start_us", "true_drift", each.alias("_d"))
    rows = stage(rows.select(*by, "window_id", "start_us", "true_drift", "_d.detector", "_d.alert"), "windows")
    key = [*by, "detector"]
    counts = quality.confusion(rows, F.col("true_drift") == 1, F.col("alert") == 1, key)
    segments = quality.drift_segments(rows, "window_id", "start_us", "true_drift", "alert", key)
    both = counts.join(quality.segment_summary(segments, key), key, "left")
    both = both.na.fill(0, ["segments_total", "segments_detected"]).na.fill(0.0, list(SEGMENT_FIGURES[2:]))
    first = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row per detector
    fixed_fp = F.max(F.when(F.col("detector") == alerts[0], F.col("fp"))).over(first)
    both = both.withColumn("false_alert_reduction", quality.fp_reduction_floored(fixed_fp, F.col("fp")))
    return both.select(*key, "points", "tp", "fp", "fn", "precision", "recall", "f1", *SEGMENT_FIGURES[:4], "false_alert_reduction")


def evaluate_run(requests: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables of a run evaluation, per stream ``by``: summary, detectors, phases, label check, errors."""
    rows = ops.evaluated_rows(requests)
    truth = F.col("ground_truth_drift") == 1
    keyed = rows if by else rows.withColumn("stream_id", F.lit("run"))
    numbered = stage(event_index(keyed, by=by or ("stream_id",), order=("ts_us", "request_id")), "run")
    detectors = []
    for name, column in (("fixed_baseline", "fixed_alert"), ("adaptive", "critical_alert")):
        counts = quality.confusion(numbered, truth, F.col(column) == 1, by)
        segments = quality.drift_segments(numbered, "idx", "ts_us", "ground_truth_drift", column, by)
        both = _with_segments(counts, segments, name, by)
        detectors.append(
            both.select(
                *by, "detector", "points", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "false_alert_rate",
                "segments_total", "segments_detected", "avg_latency_s", "p95_latency_s",
            )
        )
    both = detectors[0].unionByName(detectors[1])
    fixed = numbered.groupBy(*by).agg(F.count_if(~truth & (F.col("fixed_alert") == 1)).alias("_fixed_fp"))
    both = both.join(fixed, list(by)) if by else both.crossJoin(F.broadcast(fixed))  # one row
    both = both.withColumn("false_alert_reduction", quality.fp_reduction(F.col("_fixed_fp"), F.col("fp"))).drop("_fixed_fp")
    wrong = quality.misclassified(numbered, "ground_truth_drift", "critical_alert")
    return {
        "summary": ops.run_summary(requests),
        "detectors": both,
        "phases": quality.confusion(numbered, truth, F.col("critical_alert") == 1, [*by, "phase"]),
        "labels": verify_phase_labels(numbered),
        "errors": wrong.withColumn("feature_scores", ops.parse_feature_scores(F.col("feature_scores_json"))),
    }


def requests_of(run: ScoringRun) -> DataFrame:
    """Request-log view of a scoring run: drift evaluations as alerts, tags as labels."""
    evaluations = run.evaluations
    label = tag_present(F.col("drift_tag")).cast("int")
    return evaluations.select(
        (F.col("ts_us") / F.lit(1e6)).alias("timestamp"), "ts_us", F.col("event_id").alias("request_id"),
        F.lit("/score").alias("endpoint"), F.lit(200).alias("status_code"),
        F.coalesce("drift_tag", F.lit("normal")).alias("phase"), label.alias("ground_truth_drift"),
        F.lit(1).alias("drift_evaluated"), F.col("drift_warning_active").cast("int").alias("warning_alert"),
        F.col("drift_active").cast("int").alias("critical_alert"), F.col("drift_active").cast("int").alias("adaptive_alert"),
        F.col("drift_fixed_active").cast("int").alias("fixed_alert"), "vote_ratio", "psi_component", "ks_component",
        "prediction_component", F.col("drift_score").alias("score"), F.col("drift_threshold").alias("threshold"),
    )


def pass_summary(run: ScoringRun, name: str) -> DataFrame:
    """Alert quality and detection delay of one scoring pass, one row per stream."""
    truthy = tag_truthy(F.col("drift_tag"))
    judged = run.judged.select("stream_id", "t", "ts_us", "is_anomaly", "drift_active", "drift_tag")
    metrics = quality.alert_quality(judged, F.col("is_anomaly"), truthy, ["stream_id"])
    delay = quality.detection_delay(judged, "t", "ts_us", truthy, F.col("drift_active"), by=["stream_id"])
    return metrics.join(delay, "stream_id", "left").withColumn("pass", F.lit(name))


def compare_passes(baseline: DataFrame, tuned: DataFrame, counters: DataFrame, target_rate: float, labels: bool = True) -> DataFrame:
    """Baseline against tuned pass, one row per stream: changes, reduction, gates.

    ``labels`` says whether the events carry a label at all; without it there are no false-alert figures.
    """
    sides = baseline.unionByName(tuned)
    base, new = F.col("pass") == "baseline", F.col("pass") == "tuned"

    def of(side, column):
        return F.max(F.when(side, F.col(column)))

    row = sides.groupBy("stream_id").agg(
        of(base, "alerts").alias("baseline_alerts"), of(new, "alerts").alias("tuned_alerts"),
        of(base, "fp").alias("baseline_fp"), of(new, "fp").alias("tuned_fp"),
        of(base, "anomaly_rate").alias("baseline_rate"), of(new, "anomaly_rate").alias("tuned_rate"),
        of(base, "events_to_detect").alias("baseline_delay"), of(new, "events_to_detect").alias("tuned_delay"),
    )
    blocked = counters.select("stream_id", quality.guardrail_blocked(counters).alias("guardrail_blocked"))
    row = row.join(blocked, "stream_id", "left").na.fill(False, ["guardrail_blocked"])
    known = F.lit(labels)
    valid = quality.sample_gate(F.col("baseline_alerts"), known) & quality.sample_gate(F.col("tuned_alerts"), known)
    hard, hard_text = quality.hard_rate_gate(F.col("tuned_rate"))
    near, near_text = quality.target_rate_gate(F.col("tuned_rate"), F.lit(target_rate), blocked=F.col("guardrail_blocked"))
    return row.withColumns(
        {
            "fp_reduction": F.when(valid, quality.fp_reduction(F.col("baseline_fp"), F.col("tuned_fp"))),
            "rate_change": F.col("tuned_rate") - F.col("baseline_rate"),
            "delay_change": F.col("tuned_delay") - F.col("baseline_delay"),
            "hard_limit_passed": hard, "hard_limit_message": hard_text,
            "target_passed": near, "target_message": near_text,
        }
    )


def replay_confusion(run: ScoringRun) -> DataFrame:
    """Drift flag against the label over every event of a replay, warm-up included."""
    rows = run.output.select("stream_id", tag_present(F.col("drift_tag")).alias("truth"), F.coalesce("drift_active", F.lit(False)).alias("pred"))
    return quality.confusion(rows, F.col("truth"), F.col("pred"))


def replay_summary(run: ScoringRun) -> DataFrame:
    """Per stream: events, alerts, false alerts, and delay from drift onset to the first later detection."""
    judged = run.judged.select("stream_id", "idx", "ts_us", "is_anomaly", "drift_active", "drift_tag")
    drift = tag_present(F.col("drift_tag"))
    totals = quality.alert_quality(judged, F.col("is_anomaly"), drift, ["stream_id"])
    delay = quality.detection_delay(judged, "idx", "ts_us", drift, F.col("drift_active"), by=["stream_id"], after_onset=True)
    events = run.features.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events_total"))
    return events.join(totals, "stream_id", "left").join(delay, "stream_id", "left").select(
        "stream_id", "events_total", F.coalesce("denominator", F.lit(0)).alias("events_scored"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("fp", F.lit(0)).alias("false_alerts"), "false_alert_rate",
        "events_to_detect", "seconds_to_detect",
    )
