"""Operational counters and latency histograms over the result tables of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import tag_present
from tidegauge.operators import control, ops
from tidegauge.operators.dedupe import duplicate_counts
from tidegauge.plans.scoring import ScoringRun

ACTIONS = (control.FREEZE, control.UNFREEZE, control.REFRESH)


def _labelled(metric: str, label: str, counts: DataFrame, values) -> DataFrame:
    full = ops.zero_filled(counts, label, values)
    return full.select(F.lit(metric).alias("metric"), F.lit(label).alias("label"), F.col(label).alias("value"), F.col("count").cast("long").alias("count"))


def _plain(one_row: DataFrame) -> DataFrame:
    """A row of totals as counters without a label."""
    names = one_row.columns
    long = one_row.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "metric", "count")
    return long.select("metric", F.lit("").alias("label"), F.lit("").alias("value"), F.coalesce("count", F.lit(0)).alias("count"))


def operational_counters(
    run: ScoringRun, arrivals: DataFrame, dead_letters: dict[str, DataFrame] | None = None, controls: DataFrame | None = None, errors: DataFrame | None = None
) -> DataFrame:
    """Rows (metric, label, value, count) of all counters, with a row for every known label value.

    ``arrivals``: one row per received event with its ``source``. ``dead_letters``: rejected values by the source
    they came from. ``controls``: operator actions. ``errors``: failures with their ``component``.
    """
    spark = run.events.sparkSession
    none = spark.createDataFrame([], "value string, count long")

    def counted(rows: DataFrame | None, label: str) -> DataFrame:
        return none.withColumnRenamed("value", label) if rows is None else rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))

    duplicates = duplicate_counts(arrivals, ["source"]).withColumnRenamed("duplicates", "count")
    dead = [rows.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("count")) for source, rows in (dead_letters or {}).items()]
    rejected = reduce(DataFrame.unionByName, dead) if dead else counted(None, "source")
    truth = tag_present(F.col("drift_tag"))
    quality = run.evaluations.agg(
        F.count(F.lit(1)).alias("drift_alert_total"), F.count_if("drift_active").alias("drift_alert_positive_total"),
        F.count_if("drift_fixed_active").alias("drift_alert_fixed_positive_total"), F.count_if(truth).alias("drift_true_label_total"),
        F.count_if(truth & F.col("drift_active")).alias("drift_true_positive_total"), F.count_if(~truth & F.col("drift_active")).alias("drift_false_positive_total"),
    )
    parts = [
        _labelled("events_ingested_total", "source", counted(arrivals, "source"), ops.SOURCES),
        _labelled("duplicate_events_total", "source", duplicates, ops.SOURCES),
        _labelled("deserialize_errors_total", "source", rejected, ops.DESERIALIZE_SOURCES),
        _labelled("alerts_emitted_total", "severity", counted(run.alerts, "severity"), ops.SEVERITIES),
        _labelled("admin_actions_total", "action", counted(controls, "action"), ACTIONS),
        _labelled("errors_total", "component", counted(errors, "component"), ops.ERROR_COMPONENTS),
        _plain(run.scored.agg(F.count(F.lit(1)).alias("events_scored_total"))),
        _plain(quality),
    ]
    return reduce(DataFrame.unionByName, parts)


def latency_histograms(values: dict[str, tuple[DataFrame, str, tuple[float, ...]]]) -> DataFrame:
    """Rows (histogram, le, bucket, total, rows) of named histograms (table, seconds column, bucket edges)."""

    def one(name: str, table: DataFrame, column: str, edges: tuple[float, ...]) -> DataFrame:
        rows = ops.cumulative_histogram(table, column, edges)
        return rows.select(F.lit(name).alias("histogram"), "le", "bucket", "total")

    return reduce(DataFrame.unionByName, [one(name, *spec) for name, spec in values.items()])
