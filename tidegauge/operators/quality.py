"""Alert and drift quality against labels: confusion, delays, segments, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import ratio
from tidegauge.operators.ordering import exact_quantiles, running_totals
from tidegauge.session import small

# Limits of the run gates.
HARD_RATE_LIMIT = 0.05
RATE_TOLERANCE = 0.005
MIN_THROUGHPUT_RATIO, MAX_P99_RATIO = 0.95, 1.15
MIN_ALERTS = 50
RUN_CHUNK = 100_000


def confusion_counts(truth: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(truth & pred).alias("tp"),
        F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"),
        F.count_if(~truth & ~pred).alias("tn"),
    ]


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the share of false among fired alerts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_alert_rate": ratio(fp, tp + fp)}
    )
    return rows.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def confusion(rows: DataFrame, truth: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates, over all rows or per group (for instance per phase)."""
    return with_rates(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), *confusion_counts(truth, pred)))


def alert_quality(rows: DataFrame, alert: Column, drift: Column | None, by: Sequence[str] = ()) -> DataFrame:
    """Alert volume and, where labels exist, confusion and rates inside and outside drift."""
    grouped = rows.groupBy(*by)
    volume = [F.count_if(alert).alias("alerts"), F.count(F.lit(1)).alias("denominator")]
    labelled = ("tp", "fp", "fn", "tn", "drift_events", "non_drift_events")
    if drift is None:
        out = grouped.agg(*volume)
        for name in labelled:
            out = out.withColumn(name, F.lit(None).cast("long"))
    else:
        out = grouped.agg(
            *volume, *confusion_counts(drift, alert),
            F.count_if(drift).alias("drift_events"), F.count_if(~drift).alias("non_drift_events"),
        )

    def known(c: Column) -> Column:
        return F.lit(None).cast("double") if drift is None else c

    return out.withColumns(
        {
            "anomaly_rate": ratio(F.col("alerts"), F.col("denominator")),
            "false_alert_rate": known(ratio(F.col("fp"), F.col("alerts"))),
            "alert_rate_drift": known(ratio(F.col("tp"), F.col("drift_events"))),
            "alert_rate_non_drift": known(ratio(F.col("fp"), F.col("non_drift_events"))),
            "labels_available": F.lit(drift is not None),
        }
    )


def fp_reduction(baseline_fp: Column, tuned_fp: Column) -> Column:
    """Percent fewer false alerts; 0 without baseline false alerts."""
    return F.when(baseline_fp > 0, (baseline_fp - tuned_fp) / baseline_fp.cast("double") * 100.0).otherwise(F.lit(0.0))


def fp_reduction_floored(baseline_fp: Column, tuned_fp: Column) -> Column:
    """Variant of the window report: a baseline without false alerts counts as 1."""
    return (baseline_fp - tuned_fp) / F.greatest(baseline_fp, F.lit(1)).cast("double") * 100.0


def misclassified(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows judged wrongly, marked FP or FN."""
    wrong = rows.filter(F.col(truth) != F.col(pred))
    return wrong.withColumn("error_kind", F.when(F.col(pred) == 1, "FP").otherwise("FN"))


def misclassified_counts(wrong: DataFrame) -> DataFrame:
    return wrong.agg(
        F.count_if(F.col("error_kind") == "FP").alias("FP"), F.count_if(F.col("error_kind") == "FN").alias("FN")
    )


def detection_delay(
    rows: DataFrame,
    position: str,
    ts: str,
    drift: Column,
    detected: Column,
    by: Sequence[str] = (),
    after_onset: bool = False,
    events_per_sec: float | None = None,
) -> DataFrame:
    """Events and seconds from the first drift row to the first detection; null if either lacks.

    Without ``after_onset`` a detection before the onset counts as delay 0. ``events_per_sec``
    turns the event delay into seconds; else times are used.
    """
    marked = rows.select(*by, position, ts, drift.alias("_drift"), detected.alias("_hit"))

    def first(flag: Column, alias: str) -> Column:
        return F.min(F.when(flag, F.struct(position, ts))).alias(alias)

    if after_onset:
        onset = marked.groupBy(*by).agg(first(F.col("_drift"), "_onset"))
        if by:
            joined = marked.join(small(onset), list(by))
        else:
            joined = marked.select("*", onset.scalar().alias("_onset"))
        later = F.col("_hit") & (F.col(position) >= F.col(f"_onset.{position}"))
        out = joined.groupBy(*by).agg(F.first("_onset").alias("_onset"), first(later, "_found"))
    else:
        out = marked.groupBy(*by).agg(first(F.col("_drift"), "_onset"), first(F.col("_hit"), "_found"))
    gap = F.col(f"_found.{position}") - F.col(f"_onset.{position}")
    events = F.when(gap.isNotNull(), F.greatest(F.lit(0), gap).cast("long"))
    if events_per_sec is None:
        gap_s = (F.col(f"_found.{ts}") - F.col(f"_onset.{ts}")) / 1e6
        seconds = F.when(gap_s.isNotNull(), F.greatest(F.lit(0.0), gap_s))
    else:
        seconds = events / F.lit(max(1e-9, events_per_sec))
    return out.select(*by, events.alias("events_to_detect"), seconds.alias("seconds_to_detect"))


def drift_segments(rows: DataFrame, position: str, ts_us: str, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of label 1 in each densely numbered series ``by``, with their first detection.

    Runs are found inside position chunks. Only pieces that touch a chunk border, two per chunk at
    most, are stitched together; the rest are whole already. No global sort of the rows.
    """
    p, by = F.col("p"), list(by)
    drift = rows.filter(F.col(truth) == 1).select(
        *by, F.col(position).alias("p"), F.col(ts_us).alias("ts"), (F.col(pred) == 1).alias("hit"),
        F.floor(F.col(position) / RUN_CHUNK).alias("_chunk"),
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy("p")
    run = drift.withColumn("_run", p - F.row_number().over(inside))
    found = F.when(F.col("hit"), F.struct("p", "ts"))
    pieces = run.groupBy(*by, "_chunk", "_run").agg(
        F.min("p").alias("first_pos"), F.max("p").alias("last_pos"), F.min("ts").alias("start_us"),
        F.min(found).alias("found"),
    )
    at_border = (F.col("first_pos") == F.col("_chunk") * RUN_CHUNK) | (
        F.col("last_pos") == (F.col("_chunk") + 1) * RUN_CHUNK - 1
    )
    whole = pieces.filter(~at_border).drop("_chunk", "_run")
    order = Window.partitionBy(*by).orderBy("first_pos")
    opens = F.col("first_pos") != F.coalesce(F.lag("last_pos").over(order), F.lit(-2)) + 1
    border = pieces.filter(at_border).withColumn("_opens", opens.cast("int"))
    border = border.withColumn("_segment", F.sum("_opens").over(order))
    stitched = border.groupBy(*by, "_segment").agg(
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"),
        F.min("start_us").alias("start_us"), F.min("found").alias("found"),
    )
    segments = whole.unionByName(stitched.drop("_segment"))
    return segments.select(
        *by, "first_pos", "last_pos", "start_us", F.col("found.p").alias("detected_pos"),
        F.col("found.ts").alias("detected_us"), F.col("found").isNotNull().alias("detected"),
        F.when(F.col("found").isNotNull(), F.greatest(F.lit(0.0), (F.col("found.ts") - F.col("start_us")) / 1e6)).alias("latency_s"),
        (F.col("found.p") - F.col("first_pos")).alias("latency_windows"),
    )


def segment_summary(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Segments in all and detected, mean and p95 latency (0 when none was detected), per group ``by``."""
    hit, by = F.col("detected"), list(by)
    p95 = exact_quantiles(segments.filter(hit), by, "latency_s", {"p95": 0.95})
    totals = segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments_total"),
        F.count_if(hit).alias("segments_detected"),
        F.coalesce(F.avg(F.when(hit, F.col("latency_s"))), F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.avg(F.when(hit, F.col("latency_windows").cast("double"))), F.lit(0.0)).alias("avg_latency_windows"),
    )
    joined = totals.join(p95, by, "left") if by else totals.join(p95, F.lit(True), "left")  # one row each
    return joined.select(*totals.columns, F.coalesce("p95", F.lit(0.0)).alias("p95_latency_s"))


def hard_rate_gate(rate: Column, limit: float = HARD_RATE_LIMIT) -> tuple[Column, Column]:
    passed = ~(rate > limit)
    text = F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))
    message = F.concat(text, F.format_string(": anomaly rate %.4f, hard limit %.4f", rate, F.lit(limit)))
    return passed, message


def target_rate_gate(
    rate: Column, target: Column, tolerance: float = RATE_TOLERANCE, blocked: Column | None = None
) -> tuple[Column, Column]:
    """Rate near its target, or waived because the controller was held back by its guards."""
    near = F.abs(rate - target) <= tolerance
    waived = F.lit(False) if blocked is None else blocked
    text = F.when(near, F.lit("PASS")).when(waived, F.lit("PASS (guardrail waiver)")).otherwise(F.lit("FAIL"))
    return near | waived, F.concat(text, F.format_string(": anomaly rate %.4f, target %.4f", rate, target))


def performance_gate(base_eps: Column, tuned_eps: Column, base_p99: Column, tuned_p99: Column) -> dict[str, Column]:
    throughput = tuned_eps / F.greatest(F.lit(1e-9), base_eps)
    p99 = tuned_p99 / F.greatest(F.lit(1e-9), base_p99)
    return {
        "throughput_ratio": throughput,
        "p99_ratio": p99,
        "performance_passed": (throughput >= MIN_THROUGHPUT_RATIO) & (p99 <= MAX_P99_RATIO),
    }


def sample_gate(alerts: Column, labels_available: Column, minimum: int = MIN_ALERTS) -> Column:
    """Whether there are labels and enough alerts to speak of false-alert rates."""
    return labels_available & (alerts >= minimum)


def guardrail_blocked(counters: DataFrame) -> Column:
    """Controller counters that excuse a missed target rate."""
    idle = (F.col("updates_applied") == 0) & (
        (F.col("skipped_drift") > 0) | (F.col("skipped_cooldown") > 0) | (F.col("skipped_history") > 0)
    )
    return (F.col("bounds_limited") > 0) | (F.col("step_limited") > 0) | idle


def running_quality(evaluations: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """Precision and recall of the drift flag up to each evaluation, per stream.

    ``evaluations`` are numbered by ``u`` per stream; running counts come from the distributed
    prefix sum.
    """
    one = {
        "run_tp": (truth & pred).cast("long"),
        "run_fp": (~truth & pred).cast("long"),
        "run_true": truth.cast("long"),
    }
    rows = running_totals(evaluations, ["stream_id"], ["u"], one)
    return rows.withColumns(
        {
            "run_precision": ratio(F.col("run_tp"), F.col("run_tp") + F.col("run_fp")),
            "run_recall": ratio(F.col("run_tp"), F.col("run_true")),
        }
    )
