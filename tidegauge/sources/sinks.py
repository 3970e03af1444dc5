"""Sinks: idempotent alerts, labelled streams, fixed-precision logs, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.operators.dedupe import first_per_id
from tidegauge.session import stage

# Decimals of the log columns.
REQUEST_DECIMALS = {
    "timestamp": 6,
    "latency_ms": 4,
    "vote_ratio": 6,
    "psi_component": 6,
    "ks_component": 6,
    "prediction_component": 6,
    "score": 6,
    "threshold": 6,
}
RESOURCE_DECIMALS = {
    "timestamp": 6,
    "process_cpu_seconds_total": 6,
    "process_resident_memory_bytes": 2,
    "process_cpu_percent": 4,
}


DAY_US = 86_400_000_000


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []


def append_alerts(alerts: DataFrame, path: str, id_col: str = "alert_id") -> None:
    """Append alerts as JSON lines; ids already in the sink or repeated in the batch are skipped.

    The log has a folder for each day of ``ts_us``. An id is made from its alert's time, so equal ids lie in one day,
    and an append reads the ids of the days it writes, whatever the age of the log.
    """
    spark = alerts.sparkSession
    day = F.floor(F.col("ts_us") / DAY_US).cast("long")
    fresh = stage(first_per_id(alerts, id_col, ("ts_us",)).withColumn("day", day), "alerts")
    present = set(_folders(spark, path))
    # One number per day of the batch.
    days = [f"day={r.day}" for r in fresh.select("day").distinct().collect()]
    old = [f"{path}/{d}" for d in days if d in present]
    if old:
        seen = spark.read.schema(f"{id_col} string").json(old)
        fresh = fresh.join(seen, id_col, "left_anti")
    fresh.write.mode("append").partitionBy("day").json(path)


def read_alerts(spark: SparkSession, path: str, schema: StructType, since_us: int | None = None) -> DataFrame:
    """The alert log, of the days from ``since_us`` on if given; the days are pruned before any file is read."""
    rows = spark.read.schema(schema).json(path)
    if since_us is not None:
        rows = rows.filter((F.col("day") >= since_us // DAY_US) & (F.col("ts_us") >= since_us))
    return rows.select(*schema.names)


def fixed(c: Column, decimals: int) -> Column:
    """Fixed-point text, rounded from the exact binary value as C and Python do."""
    return F.call_function("format_number", c, F.lit("0." + "0" * decimals))


def with_decimals(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    return df.select(
        *[fixed(F.col(c), decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns]
    )


def write_request_log(rows: DataFrame, path: str) -> None:
    with_decimals(rows, REQUEST_DECIMALS).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_resource_log(rows: DataFrame, path: str) -> None:
    with_decimals(rows, RESOURCE_DECIMALS).write.mode("overwrite").csv(path, header=True)


def labelled_stream(events: DataFrame, phase: Column, label: Column) -> DataFrame:
    """Nested rows (request_id, timestamp, phase, ground_truth_drift, event)."""
    seconds = F.col("ts_us") / F.lit(1e6)
    event = F.struct(
        "event_id", seconds.alias("ts"), "entity_id", "amount", "merchant_id", "merchant_category",
        "country", "channel", "device_type",
        F.when(label == 1, phase).alias("drift_tag"),
    )
    return events.select(
        F.col("event_id").alias("request_id"), seconds.alias("timestamp"), phase.alias("phase"),
        label.alias("ground_truth_drift"), event.alias("event"),
    )


def write_labelled_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_flat_rows(rows: DataFrame) -> DataFrame:
    """The CSV form: the event as one JSON column."""
    return rows.select(
        "request_id", "timestamp", "phase", "ground_truth_drift",
        F.to_json("event", {"ignoreNullFields": "false"}).alias("event_json"),
    )


def write_labelled_csv(rows: DataFrame, path: str) -> None:
    as_flat_rows(rows).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON document: the summary is one row by construction."""
    summary.coalesce(1).write.mode("overwrite").json(path)
