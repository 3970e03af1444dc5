"""Count windows over an indexed table and trailing statistics of their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import BINS
from tidegauge.functions import distance as D
from tidegauge.functions.scalar import is_finite
from tidegauge.operators.ordering import with_halo
from tidegauge.operators.profile import DECILES
from tidegauge.session import hinted, stage

SERIES_CHUNK = 4096


def count_windows(indexed: DataFrame, reference_size: int, size: int, step: int) -> DataFrame:
    """Rows of an indexed table (idx from 1) with the window(s) they fall in after the reference.

    Window w covers positions [reference + w*step, +size); a row is copied only where windows
    overlap, and rows between windows of a wide step drop out.
    """
    pos = F.col("idx") - 1 - reference_size
    last = F.floor(pos / step).cast("long")
    first = F.greatest(F.lit(0), F.ceil((pos - size + 1) / step).cast("long"))
    return (
        indexed.filter(F.col("idx") > reference_size)
        .withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
    )


def _open_bin(value: Column, edges: Column) -> Column:
    """Bin of a finite value between infinite outer edges: the number of edges not above it."""
    return F.least(F.size(F.filter(edges, lambda e: e <= value)), F.lit(BINS))


def window_psi(
    indexed: DataFrame,
    features: Sequence[str],
    pred: str | None,
    label: str,
    reference_size: int,
    size: int,
    step: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per whole window of each stream ``by``: bounds, label share, and the largest PSI over the columns.

    A stream's reference is its first ``reference_size`` rows, so its profile is one bounded row. Each
    window is then one aggregate that gives its bounds, its label and the counts of all bins.
    """
    by = list(by)
    columns = [*features, *([pred] if pred else [])]
    values = [F.col(c).cast("double").alias(c) for c in columns]
    indexed = stage(indexed.select(*by, "idx", "ts_us", label, *values), "indexed")
    levels = F.array(*[F.lit(p) for p in DECILES])
    inf = F.lit(float("inf"))
    reference = indexed.filter(F.col("idx") <= reference_size)
    found = reference.groupBy(*by).agg(*[F.percentile(F.when(is_finite(F.col(c)), F.col(c)), levels).alias(f"_q{k}") for k, c in enumerate(columns)])
    edges = found.select(*by, *[F.concat(F.array(-inf), F.slice(f"_q{k}", 2, BINS - 1), F.array(inf)).alias(f"_e{k}") for k in range(len(columns))])
    edges = stage(edges, "edges")

    def binned(rows: DataFrame) -> DataFrame:
        joined = rows.join(hinted(edges), by) if by else rows.crossJoin(F.broadcast(edges))  # one row
        bins = [F.when(is_finite(F.col(c)), _open_bin(F.col(c), F.col(f"_e{k}"))).alias(f"_b{k}") for k, c in enumerate(columns)]
        return joined.select(*rows.columns, *bins)

    def counts(prefix: str) -> list[Column]:
        return [
            *[F.count_if(F.col(f"_b{k}") == i).alias(f"{prefix}{k}_{i}") for k in range(len(columns)) for i in range(1, BINS + 1)],
            *[F.count(f"_b{k}").alias(f"{prefix}n{k}") for k in range(len(columns))],
        ]

    profile = stage(binned(reference).groupBy(*by).agg(*counts("r")), "profile")
    windows = binned(count_windows(indexed, reference_size, size, step)).groupBy(*by, "window_id").agg(
        F.min("idx").alias("_first"), F.max("idx").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.min_by("ts_us", "idx").alias("_start"), F.max_by("ts_us", "idx").alias("_end"),  # structs would have the rows sorted
        F.avg(F.col(label).cast("double")).alias("label_share"), *counts("c"),
    ).filter(F.col("_n") == size)
    joined = windows.join(hinted(profile), by) if by else windows.crossJoin(F.broadcast(profile))

    def distance(k: int) -> Column:
        shares = [[D.zero_floored_share(f"{p}{k}_{i}", f"{p}n{k}") for i in range(1, BINS + 1)] for p in "cr"]
        return F.when((F.col(f"cn{k}") > 0) & (F.col(f"rn{k}") > 0), D.psi(*shares)).otherwise(F.lit(0.0))

    every = [distance(k) for k in range(len(columns))]
    return joined.select(
        *by, "window_id", (F.col("_first") - 1).alias("start_idx"), F.col("_last").alias("end_idx"),
        F.col("_start").alias("start_us"), F.col("_end").alias("end_us"),
        (F.col("label_share") >= 0.5).cast("int").alias("true_drift"), (F.greatest(*every) if len(every) > 1 else every[0]).alias("max_psi"),
    )


def trailing_threshold(
    windows: DataFrame, fixed: float, history: int = 20, quantile: float = 0.95, floor: float = 0.7, by: Sequence[str] = ()
) -> DataFrame:
    """Adaptive alert threshold: quantile of a stream's previous windows' scores once there are enough.

    Windows are cut into chunks with a halo of one history, so a long series is not ordered in
    one task.
    """
    size = max(SERIES_CHUNK, history)
    frame = Window.partitionBy(*by, "_chunk").orderBy("window_id").rowsBetween(-history, -1)
    rows = with_halo(windows, "window_id", size, history)
    level = F.percentile("max_psi", F.lit(quantile)).over(frame)
    rows = rows.withColumn("_q", level).filter("_core").drop("_chunk", "_core")
    ready = F.col("window_id") >= max(5, history)
    limit = F.when(ready, F.greatest(F.col("_q"), F.lit(fixed * floor))).otherwise(F.lit(fixed))
    rows = rows.withColumn("adaptive_threshold", limit).drop("_q")
    return rows.withColumns(
        {
            "alert_fixed": (F.col("max_psi") >= fixed).cast("int"),
            "alert_adaptive": (F.col("max_psi") >= F.col("adaptive_threshold")).cast("int"),
        }
    )


def trailing_alert_rate(alerts: DataFrame, by: Sequence[str], seconds: int = 60) -> DataFrame:
    """Alerts in the trailing ``seconds`` of event time at each alert, itself included.

    Alerts are counted per instant first. Inside time chunks an instant adds its count when it comes and takes it
    back when it leaves the window, so a running total gives the trailing one, however many instants a window has.
    """
    width = seconds * 1_000_000
    counted = alerts.groupBy(*by, "ts_us").agg(F.count(F.lit(1)).alias("_n"))
    rows = with_halo(counted, "ts_us", 10 * width, width)
    comes = F.struct(F.col("ts_us").alias("_at"), F.col("_n").alias("_step"), F.col("_core").alias("_shown"))
    leaves = F.struct((F.col("ts_us") + width + 1).alias("_at"), (-F.col("_n")).alias("_step"), F.lit(False).alias("_shown"))
    steps = rows.select(*by, "_chunk", "ts_us", "_n", F.explode(F.array(comes, leaves)).alias("_s")).select(*by, "_chunk", "ts_us", "_n", "_s.*")
    frame = Window.partitionBy(*by, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("alerts_trailing", F.sum("_step").over(frame)).filter("_shown")
    return steps.select(*by, "ts_us", F.col("_n").alias("alerts_now"), "alerts_trailing")


def alert_rate_summary(rates: DataFrame, by: Sequence[str], cap: float) -> DataFrame:
    """Mean and largest trailing rate over alerts, and whether the cap was broken.

    Alerts that share an instant see rates n-k+1 .. n; their mean follows from the counts.
    """
    now, top = F.col("alerts_now"), F.col("alerts_trailing")
    seen = now * top - now * (now - 1) / 2
    return rates.groupBy(*by).agg(
        (F.sum(seen) / F.sum(now)).alias("avg_alerts_per_minute"),
        F.max(top).cast("double").alias("max_alerts_per_minute"),
        F.max(top > cap).alias("cap_breached"),
    )


def rolling_percentile(
    rows: DataFrame, by: Sequence[str], position: str, value: str, level: float, window: int, every: int, name: str
) -> DataFrame:
    """Percentile of the trailing ``window`` values at every ``every``-th position."""
    by = list(by)
    size = max(SERIES_CHUNK, window)
    items = with_halo(rows.select(*by, position, value), position, size, window)
    groups = items.groupBy(*by, "_chunk")
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)

    def rolling(pdf):
        import numpy as np

        pdf = pdf.sort_values(position)
        values, at, core = pdf[value].to_numpy(float), pdf[position].to_numpy(), pdf["_core"].to_numpy()
        ticks = np.flatnonzero(core & (at % every == 0))
        out = [np.quantile(values[max(0, i + 1 - window) : i + 1], level) for i in ticks]
        return pdf.iloc[ticks][[*by, position]].assign(**{name: out})

    return groups.applyInPandas(rolling, f"{key_types + ', ' if by else ''}{position} long, {name} double")


def series_summary(series: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """avg / max / latest of a series, one row without groups even when it is empty."""
    return series.groupBy(*by).agg(
        F.avg(value).alias("avg_ms"), F.max(value).alias("max_ms"), F.max_by(value, position).alias("latest_ms")
    )


def counter_rate(prev: Column, cur: Column, dt: Column) -> Column:
    """Percent per second of a rising counter; null on resets, bad intervals and idle starts."""
    rise = cur - prev
    ok = (dt > 0) & (rise >= 0) & ((prev > 0) | (cur > 0))
    return F.when(ok, rise / dt * 100.0)
