"""Alert rows from judged events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import severity, stable_id


def alerts_of(judged: DataFrame) -> DataFrame:
    """One alert per event at or above its threshold, with drift state and metadata.

    The id hashes canonical text (microseconds, score with nine decimals), so replays agree.
    """
    score, threshold = F.col("score"), F.col("threshold")
    key = [F.lit("alert"), F.col("event_id"), F.col("ts_us"), F.format_string("%.9f", score)]
    fields = ("drift_active", "drift_fixed_active", "drift_warning_active", "drift_evaluated", "drift_score",
              "drift_threshold", "vote_ratio", "psi_component", "ks_component", "prediction_component")
    have = [f for f in fields if f in judged.columns]
    state = F.struct(*have) if have else F.struct(F.lit(False).alias("drift_active"))
    metadata = F.create_map(
        *[x for c in ("merchant_category", "country", "channel") for x in (F.lit(c), F.col(c))]
    )
    return judged.filter(score >= threshold).select(
        stable_id(*key).alias("alert_id"), "stream_id", "ts_us", "entity_id", "event_id", "score", "threshold",
        severity(score, threshold).alias("severity"), F.lit("score>=threshold").alias("reason"),
        state.alias("drift_state"), metadata.alias("metadata"),
    )


def circuit_alerts(openings: DataFrame) -> DataFrame:
    """Critical alerts for lag circuit openings."""
    return openings.select(
        stable_id(F.lit("lag_circuit"), F.col("stream_id"), F.col("ts_us")).alias("alert_id"),
        "stream_id", "ts_us", F.lit("system").alias("entity_id"),
        F.lit("lag-circuit-breaker").alias("event_id"), F.lit(1.0).alias("score"), F.lit(1.0).alias("threshold"),
        F.lit("critical").alias("severity"), F.lit("processing_lag_threshold_exceeded").alias("reason"),
        F.col("lag_s").alias("processing_lag_seconds"),
    )
