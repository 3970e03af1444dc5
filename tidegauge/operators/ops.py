"""Operational summaries over logs and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalar import ratio
from tidegauge.operators.ordering import exact_quantiles, with_previous
from tidegauge.operators.windows import counter_rate
from tidegauge.session import small

# Bucket edges (seconds) and label sets.
SCORE_LATENCY_EDGES = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
FEATURE_LATENCY_EDGES = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
LAG_EDGES = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)
SEVERITIES = ("low", "medium", "high", "critical")
SOURCES = ("stream", "api")
DESERIALIZE_SOURCES = ("kafka", "replay")
ERROR_COMPONENTS = ("stream", "feature", "model", "drift", "api")
LATENCY_LEVELS = {"latency_p50_ms": 0.50, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
FEATURE_SCORES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
MB = 1024.0 * 1024.0
RESOURCE_CHUNK_S = 86_400.0


def is_ok(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def evaluated_rows(requests: DataFrame) -> DataFrame:
    """Ok rows at which the detector ran, or all ok rows when it never did.

    The fallback is a scalar subquery of the same plan, not a second action.
    """
    ok = requests.filter(is_ok(F.col("status_code")))
    ran = F.col("drift_evaluated") == 1
    never = ok.agg(~F.coalesce(F.max(ran), F.lit(False))).scalar()
    return ok.filter(ran | never)


def parse_feature_scores(raw: Column) -> Column:
    """JSON feature scores as a map; empty map where it is not a JSON object."""
    return F.coalesce(F.from_json(raw, FEATURE_SCORES), F.create_map().cast(FEATURE_SCORES))


def run_summary(requests: DataFrame) -> DataFrame:
    """Rate over the time span, latency percentiles of ok rows, error and uptime shares."""
    ok = is_ok(F.col("status_code"))
    totals = requests.agg(
        F.count(F.lit(1)).alias("requests_total"), F.count_if(ok).alias("requests_ok"),
        F.greatest(F.lit(1e-9), F.max("timestamp") - F.min("timestamp")).alias("duration_s"),
    )
    levels = exact_quantiles(requests.filter(ok), [], "latency_ms", LATENCY_LEVELS)
    both = totals.crossJoin(F.broadcast(levels))  # one row each
    rows = both.select(*totals.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in LATENCY_LEVELS])
    total, good = F.col("requests_total"), F.col("requests_ok")
    return rows.withColumns(
        {
            "sustained_rps": total / F.col("duration_s"),
            "error_rate_percent": ratio(total - good, total) * 100.0,
            "uptime_percent": ratio(good, total) * 100.0,
        }
    )


def cpu_memory(resources: DataFrame, by: Sequence[str] = ("host",)) -> DataFrame:
    """Mean and p95 of CPU and memory per process log.

    CPU samples are the positive direct readings and the rates of the CPU counter; a log with
    fewer than two rows gives its direct readings as they are.
    """
    by = list(by)
    sizes = resources.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    last = ("timestamp", "process_cpu_seconds_total")
    rows = with_previous(resources, by, last, last, RESOURCE_CHUNK_S).join(small(sizes), by)
    gap = F.col("timestamp") - F.col("_prev.timestamp")
    direct = F.col("process_cpu_percent")
    direct = F.when((F.col("_rows") < 2) | (direct > 0), direct)
    derived = counter_rate(F.col("_prev.process_cpu_seconds_total"), F.col("process_cpu_seconds_total"), gap)
    memory = F.col("process_resident_memory_bytes") / MB
    samples = rows.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit("cpu").alias("kind"), direct.alias("value")),
                F.struct(F.lit("cpu").alias("kind"), derived.alias("value")),
                F.struct(F.lit("memory").alias("kind"), memory.alias("value")),
            )
        ).alias("_s"),
    ).select(*by, "_s.*").filter("value IS NOT NULL")
    means = samples.groupBy(*by, "kind").agg(F.avg("value").alias("mean"))
    p95 = exact_quantiles(samples, [*by, "kind"], "value", {"p95": 0.95})
    both = means.join(p95, [*by, "kind"])

    def of(kind: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))

    return both.groupBy(*by).agg(
        of("cpu", "mean").alias("cpu_avg_percent"), of("cpu", "p95").alias("cpu_p95_percent"),
        of("memory", "mean").alias("memory_avg_mb"), of("memory", "p95").alias("memory_p95_mb"),
    )


def traffic_mix(requests: DataFrame) -> DataFrame:
    """Counts by endpoint and by phase, in one pass."""
    sets = requests.groupingSets([("endpoint",), ("phase",)], "endpoint", "phase")
    return sets.agg(F.count(F.lit(1)).alias("requests"))


def zero_filled(counts: DataFrame, label: str, values: Sequence[str], count: str = "count") -> DataFrame:
    """Counts with a row for every known label value, 0 where nothing was counted."""
    known = counts.sparkSession.createDataFrame([(v,) for v in values], f"{label} string")
    return known.join(counts, label, "left").select(label, F.coalesce(count, F.lit(0)).alias(count))


def counter(rows: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return zero_filled(counts, label, values)


def cumulative_histogram(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Bucket counts at or below each edge, the open bucket, and the sum, in one aggregate."""
    v = F.col(value)
    names = [(str(e), v <= e) for e in edges] + [("+Inf", v.isNotNull())]
    one = rows.agg(
        *[F.count_if(test).alias(f"_{i}") for i, (_, test) in enumerate(names)], F.sum(v).alias("total")
    )
    items = F.array(
        *[F.struct(F.lit(n).alias("le"), F.col(f"_{i}").alias("bucket")) for i, (n, _) in enumerate(names)]
    )
    return one.select(F.explode(items).alias("_i"), "total").select("_i.le", "_i.bucket", "total")


def component_profile(times: DataFrame, components: Sequence[str], by: str = "run") -> DataFrame:
    """Per-event milliseconds and share of the total per component and run.

    ``times`` has one row per scored event and a column per component.
    """
    sums = times.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in components])
    long = sums.unpivot([by, "_n"], list(components), "component", "_ms")
    per_event = long.select(by, "component", (F.col("_ms") / F.greatest(F.lit(1), F.col("_n"))).alias("ms_per_event"))
    total = F.sum("ms_per_event").over(Window.partitionBy(by))
    share = F.col("ms_per_event") / F.greatest(F.lit(1e-9), total) * 100.0
    return per_event.withColumn("percent_of_total", share)


def top_regressions(profile: DataFrame, baseline: str, tuned: str, by: str = "run", top: int = 3) -> DataFrame:
    """Components whose per-event time grew most between two runs."""
    a = profile.filter(F.col(by) == baseline).select("component", F.col("ms_per_event").alias("baseline_ms"))
    b = profile.filter(F.col(by) == tuned).select("component", F.col("ms_per_event").alias("tuned_ms"))
    delta = F.col("tuned_ms") - F.col("baseline_ms")
    rows = a.join(b, "component").withColumn("delta_ms", delta)
    percent = F.col("delta_ms") / F.greatest(F.lit(1e-9), F.col("baseline_ms")) * 100.0
    return rows.withColumn("delta_percent", percent).orderBy(F.desc("delta_ms"), "component").limit(top)


def availability_percent(runtime_s: Column, downtime_s: Column) -> Column:
    """Share of the run without downtime, in percent; 0 without a run."""
    share = F.lit(1.0) - F.greatest(F.lit(0.0), downtime_s) / runtime_s
    return F.when(runtime_s > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100.0).otherwise(F.lit(0.0))


def newest_alerts(alerts: DataFrame, limit: int, cap: int = 200) -> DataFrame:
    """Newest alerts first; the limit is bounded by the report cap."""
    return alerts.orderBy(F.desc("ts_us"), F.desc("alert_id")).limit(min(limit, cap))
