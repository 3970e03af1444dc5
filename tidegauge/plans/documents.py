"""Run documents: one nested JSON object per run, from the tables a job has made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import PHASE_LABELS
from tidegauge.operators import quality

ALIGNMENT = "Only rows at which the detector ran are compared, so alerts and labels share their windows."


def listed(table: DataFrame, name: str, order: str) -> DataFrame:
    """A table of few rows (detectors, phases, parameter sets) as one row with an array of structs, by ``order``."""
    first = F.struct(F.col(order).alias("_order"), *table.columns)
    rows = F.sort_array(F.collect_list(first))
    return table.agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in table.columns])).alias(name))


def joined(*rows: DataFrame) -> DataFrame:
    """One row from tables of one row each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)


def run_document(tables: dict[str, DataFrame], resources: DataFrame | None = None) -> DataFrame:
    """The document of a run evaluation (``reports.evaluate_run``): volume and latency, detectors side by side, the
    confusion of the adaptive one, phases, label check, error counts, alignment, reliability."""
    wrong = quality.misclassified_counts(tables["errors"])
    parts = [
        tables["summary"], listed(tables["detectors"], "_detectors", "detector"), listed(tables["phases"], "phase_metrics", "phase"),
        tables["labels"].withColumnRenamed("valid", "labels_valid"), listed(wrong, "_wrong", wrong.columns[0]),
    ]
    if resources is not None:
        parts.append(listed(resources, "resources", resources.columns[0]))
    one = joined(*parts)

    def detector(name: str) -> Column:
        return F.filter("_detectors", lambda d: d["detector"] == name)[0]

    adaptive = detector("adaptive")
    mapping = F.create_map(*[F.lit(x) for pair in PHASE_LABELS.items() for x in pair])
    kept = [c for c in tables["summary"].columns]
    return one.select(
        *kept,
        F.struct(detector("fixed_baseline").alias("fixed_baseline"), adaptive.alias("adaptive")).alias("baseline_vs_adaptive"),
        F.struct(*[adaptive[c].alias(c.upper()) for c in ("tp", "fp", "tn", "fn")]).alias("confusion_matrix"),
        adaptive["precision"].alias("alert_precision"), adaptive["recall"].alias("alert_recall"), adaptive["f1"].alias("alert_f1"),
        adaptive["false_alert_reduction"].alias("false_alert_reduction_percent"),
        "phase_metrics",
        F.col("_wrong").alias("fn_fp_analysis"),
        F.struct("checked_rows", "mismatches", mapping.alias("mapping"), F.col("labels_valid").alias("valid")).alias("phase_label_verification"),
        F.struct(F.lit("windowed").alias("mode"), F.col("checked_rows").alias("compared_rows"), F.lit(ALIGNMENT).alias("description")).alias("alignment"),
        F.col("checked_rows").alias("drift_eval_points"),
        *(["resources"] if resources is not None else []),
    )


def sweep_document(best: DataFrame) -> DataFrame:
    """The document of a threshold sweep: the best parameter set, and the best few in order of ``place``."""
    return listed(best, "top", "place").select(F.col("top")[0].alias("best"), "top")


def report_document(report: DataFrame, windows: DataFrame) -> DataFrame:
    """The document of a windowed drift report: its detectors, and the number and span of the windows."""
    span = windows.agg(F.count(F.lit(1)).alias("windows"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    return joined(listed(report, "detectors", "detector"), span)
