"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import ControlConfig, DriftConfig, EngineConfig, FeatureConfig, ModelConfig
from tidegauge.functions.scalar import processing_lag
from tidegauge.operators.inject import inject, shift_columns
from tidegauge.operators.ordering import event_index
from tidegauge.operators.phases import phase_by_share
from tidegauge.plans.scoring import ScoringRun
from tidegauge.sources.events import DEFAULT_STREAM, canonical_events

US = 1_000_000
RUN_START = 1_704_067_200 * US  # 2024-01-01
RUN_DAYS = 30
DRIFT_FROM, DRIFT_TO = 1_705_622_400 * US, 1_706_140_800 * US  # 2024-01-19 .. 2024-01-25
MIDPOINT = 1_705_363_200 * US  # 2024-01-16
WINDOW_SECONDS = 7 * 86_400

CONFIG = EngineConfig(
    features=FeatureConfig(window_seconds=WINDOW_SECONDS),
    model=ModelConfig(kind="zscore"),
    drift=DriftConfig(adwin_enabled=False),
    control=ControlConfig(
        initial_threshold=0.95, min_threshold=0.5, max_threshold=0.9999, max_step=0.02,
        audit_sample_rate=0.5, audit_cooldown_seconds=86_400.0, audit_min_delta=0.002,
    ),
)
FEEDBACK = ControlConfig(
    initial_threshold=0.95, min_threshold=0.5, max_threshold=0.9999, max_step=0.005, cooldown_seconds=0.0,
    min_history=1000, history=3000, interval=100, adapt_during_drift=True, rate_feedback=True, tolerance=0.0025,
)
# For the smallest tables, which are shorter than the default warm-up.
SMALL_CONFIG = EngineConfig(
    features=FeatureConfig(window_seconds=WINDOW_SECONDS),
    model=ModelConfig(kind="zscore", warmup_events=150),
    drift=DriftConfig(reference_events=200, window_size=100, interval=20, min_samples=20, adwin_clock=20),
    control=ControlConfig(initial_threshold=0.95, min_threshold=0.5, max_threshold=0.9999, max_step=0.02, min_history=50),
)

_runs: dict[tuple, ScoringRun] = {}


def forget_runs() -> None:
    """Drop shared scoring runs, so that the next query computes everything itself."""
    _runs.clear()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the mean-shift pattern on a week of the run."""
    rows = canonical_events(spark, sf_dir)
    return inject(rows, "mean_shift_amount", F.col("ts_us").between(DRIFT_FROM, DRIFT_TO))


def run(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CONFIG) -> ScoringRun:
    """Scoring run shared by the queries of a session that read its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, cfg)
    if key not in _runs:
        _runs[key] = ScoringRun(events(spark, sf_dir), cfg)
    return _runs[key]


def k_of() -> Column:
    return F.col("merchant_id").cast("int")


def run_share() -> Column:
    return (F.col("ts_us") - F.lit(RUN_START)) / F.lit(float(RUN_DAYS * 86_400 * US))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log seen through the events: one request per event."""
    k = k_of()
    phase, label = phase_by_share(run_share())
    endpoint = F.element_at(F.array(F.lit("/score"), F.lit("/predict"), F.lit("/detect_drift")), k % 3 + 1)
    # The detectors see amounts only; the label comes from the phase.
    fixed = (F.col("amount") > 90.0).cast("int")
    critical = ((F.col("amount") > 70.0) & (k % 2 == 0)).cast("int")
    scores = F.when(k % 10 == 0, F.lit("not json")).when(k % 10 == 1, F.lit("")).otherwise(
        F.format_string('{"amt":{"psi":%.2f,"ks":%.3f}}', k / 100.0, k / 1000.0)
    )
    return events(spark, sf_dir).select(
        (F.col("ts_us") / F.lit(1e6)).alias("timestamp"), F.col("event_id").alias("request_id"), endpoint.alias("endpoint"),
        F.when(k == 0, 500).when(k == 1, 404).otherwise(200).alias("status_code"),
        (F.col("amount") / 8.0).alias("latency_ms"), phase.alias("phase"),
        F.when(k == 50, 1 - label).otherwise(label).alias("ground_truth_drift"),
        (F.col("event_id").cast("long") % 5 == 0).cast("int").alias("drift_evaluated"),
        F.greatest(fixed, critical).alias("warning_alert"),
        critical.alias("critical_alert"), critical.alias("adaptive_alert"), fixed.alias("fixed_alert"),
        (k / 100.0).alias("vote_ratio"), (k / 200.0).alias("psi_component"), (k / 400.0).alias("ks_component"),
        (k / 800.0).alias("prediction_component"), scores.alias("feature_scores_json"),
        (F.col("amount") / 100.0).alias("score"), F.lit(0.8).alias("threshold"), F.lit("").alias("error"), "ts_us",
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples, one log per event type: a counter that resets now and then."""
    k = k_of()
    return events(spark, sf_dir).select(
        F.col("merchant_category").alias("host"), (F.col("ts_us") / F.lit(1e6)).alias("timestamp"),
        F.when(k == 3, 0.0).otherwise((F.col("ts_us") - RUN_START) / 1e8 + k).alias("process_cpu_seconds_total"),
        (F.col("amount") * 1048576.0).alias("process_resident_memory_bytes"),
        F.when(k % 4 == 0, k / 2.0).otherwise(0.0).alias("process_cpu_percent"),
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide feature rows from order lines in ship order, with three labelled drift segments."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    rows = raw.select(
        F.lit(DEFAULT_STREAM).alias("stream_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("row_id"),
        "l_partkey", "l_suppkey", "l_returnflag",
        (day.cast("long") * 86_400 * US).alias("ts_us"),
        F.col("l_quantity").cast("double").alias("feature_1"),
        F.col("l_extendedprice").cast("double").alias("feature_2"),
        F.col("l_discount").cast("double").alias("feature_3"),
        (F.col("l_tax").cast("double") * 10.0).alias("pred_score"),
        day.alias("day"),
    )
    first = F.col("day").between(9700, 9850)
    second = F.col("day").between(10300, 10420)
    third = F.col("day").between(10900, 11000)
    rows = shift_columns(rows, first, {"feature_1": {"offset": 15.0}, "pred_score": {"offset": 0.25, "low": 0.0, "high": 1.0}})
    rows = shift_columns(rows, second, {"feature_2": {"scale": 1.35}, "feature_3": {"offset": -0.03}})
    rows = shift_columns(rows, third, {"feature_1": {"offset": -12.0}, "feature_2": {"offset": 9000.0}, "pred_score": {"offset": -0.2, "low": 0.0, "high": 1.0}})
    return rows.drop("day")


FEATURE_COLUMNS = ("feature_1", "feature_2", "feature_3")
# Order keys repeat in the table; rows equal in all of these are interchangeable.
FEATURE_ORDER = ("ts_us", "row_id", "l_partkey", "l_suppkey", *FEATURE_COLUMNS, "pred_score")


def feature_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows as three streams, by the return flag of their order line."""
    return feature_table(spark, sf_dir).withColumn("stream_id", F.col("l_returnflag"))


def indexed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_index(feature_table(spark, sf_dir), order=FEATURE_ORDER)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two samples of amounts per event type: before and from the middle of the run."""
    rows = events(spark, sf_dir).select(F.col("merchant_category").alias("feature"), F.col("amount").alias("value"), "ts_us")
    before = F.col("ts_us") < MIDPOINT
    return rows.filter(before).drop("ts_us"), rows.filter(~before).drop("ts_us")


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator actions read off the events: three values of k stand for the three actions."""
    k = k_of()
    action = F.when(k == 7, "freeze_adaptation").when(k == 13, "unfreeze_adaptation").when(k == 29, "refresh_reference")
    return (
        events(spark, sf_dir)
        .withColumn("action", action)
        .filter("action IS NOT NULL")
        .select(
            "stream_id", "ts_us", "action",
            F.when(F.col("entity_id").cast("long") % 2 == 0, F.concat(F.lit("op_"), "entity_id")).alias("actor"),
            F.when(F.col("entity_id").cast("long") % 3 == 0, F.lit("review")).alias("reason"),
        )
    )


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing lag per event: event age, or time since ingest where k is even."""
    k = k_of()
    event_s = F.col("ts_us") / F.lit(1e6)
    ingested = F.when(k % 2 == 0, event_s + k / 40.0)
    processed = event_s + k / 16.0 - 0.25
    return events(spark, sf_dir).select(
        "stream_id", "ts_us", "event_id", processing_lag(processed, ingested, event_s).alias("lag_s")
    )
