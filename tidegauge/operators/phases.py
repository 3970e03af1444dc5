"""Workload phases: validation, labelling by elapsed time, label checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import PHASE_LABELS

Phase = tuple[str, float, int, str]
PHASE_LIMIT = 1000


def phase_table(spark: SparkSession, phases: Sequence[Phase]) -> DataFrame:
    """Dimension (phase, pattern, ground_truth_drift, start_s, end_s); the last phase never ends."""
    if not phases or len(phases) > PHASE_LIMIT:
        raise ValueError("between 1 and 1000 phases are needed")
    rows, start = [], 0.0
    for i, (name, seconds, label, pattern) in enumerate(phases):
        if seconds <= 0:
            raise ValueError(f"phase {name}: duration must be positive, got {seconds}")
        if label not in (0, 1):
            raise ValueError(f"phase {name}: label must be 0 or 1, got {label}")
        end = float("inf") if i == len(phases) - 1 else start + seconds
        rows.append((i, name, pattern, label, start, end, float(seconds)))
        start += seconds
    return spark.createDataFrame(
        rows,
        "ordinal int, phase string, pattern string, ground_truth_drift int, start_s double, end_s double, seconds double",
    )


def label_phases(rows: DataFrame, elapsed: str, phases: DataFrame) -> DataFrame:
    """Rows with phase, label and progress, by a range join on the small phase table."""
    at = F.col(elapsed)
    dim = F.broadcast(phases)
    hit = (at < dim["end_s"]) & ((at >= dim["start_s"]) | (dim["ordinal"] == 0))
    inside = at - F.col("start_s")
    progress = F.when(inside >= F.col("seconds"), F.lit(1.0)).otherwise(
        inside / F.greatest(F.lit(1.0), F.col("seconds"))
    )
    return rows.join(dim, hit).select(*rows.columns, "phase", "pattern", "ground_truth_drift", progress.alias("progress"))


# Phases by share of a run (upper bound, name, label).
RUN_SHARES = ((0.35, "normal", 0), (0.60, "gradual_drift", 1), (0.80, "sudden_drift", 1), (None, "noisy_non_drift", 0))


def phase_by_share(share: Column) -> tuple[Column, Column]:
    """Phase name and label from the share of the run gone by."""
    name, label = F.lit(RUN_SHARES[-1][1]), F.lit(RUN_SHARES[-1][2])
    for bound, phase, drift in reversed(RUN_SHARES[:-1]):
        name = F.when(share < bound, F.lit(phase)).otherwise(name)
        label = F.when(share < bound, F.lit(drift)).otherwise(label)
    return name, label


def verify_phase_labels(rows: DataFrame, expected: dict[str, int] = PHASE_LABELS) -> DataFrame:
    """One row: rows checked, rows whose label contradicts their phase, and the verdict."""
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    wrong = F.coalesce(want[F.col("phase")] != F.col("ground_truth_drift"), F.lit(False))
    out = rows.agg(F.count(F.lit(1)).alias("checked_rows"), F.count_if(wrong).alias("mismatches"))
    return out.withColumn("valid", F.col("mismatches") == 0)
