"""Readers of feature CSVs, request and resource logs, and metric scrapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Log columns.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("phase", T.StringType()),
        T.StructField("ground_truth_drift", T.IntegerType()),
        T.StructField("drift_evaluated", T.IntegerType()),
        T.StructField("warning_alert", T.IntegerType()),
        T.StructField("critical_alert", T.IntegerType()),
        T.StructField("adaptive_alert", T.IntegerType()),
        T.StructField("fixed_alert", T.IntegerType()),
        T.StructField("vote_ratio", T.DoubleType()),
        T.StructField("psi_component", T.DoubleType()),
        T.StructField("ks_component", T.DoubleType()),
        T.StructField("prediction_component", T.DoubleType()),
        T.StructField("feature_scores_json", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)
RESOURCE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("process_cpu_seconds_total", T.DoubleType()),
        T.StructField("process_resident_memory_bytes", T.DoubleType()),
        T.StructField("process_cpu_percent", T.DoubleType()),
    ]
)


def _csv_by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns taken by header name and cast; columns the files lack are null."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    have = set(raw.columns)
    return raw.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def with_request_defaults(rows: DataFrame, evaluated_default: int = 1) -> DataFrame:
    """Fill the columns a minimal log leaves out."""
    zero = F.lit(0)
    filled = {
        "drift_evaluated": F.coalesce("drift_evaluated", F.lit(evaluated_default)),
        "critical_alert": F.coalesce("critical_alert", "adaptive_alert", zero),
        "adaptive_alert": F.coalesce("adaptive_alert", zero),
        "warning_alert": F.coalesce("warning_alert", zero),
        "feature_scores_json": F.coalesce("feature_scores_json", F.lit("")),
        "phase": F.coalesce("phase", F.lit("unknown")),
        "request_id": F.coalesce("request_id", F.lit("")),
        "endpoint": F.coalesce("endpoint", F.lit("")),
    }
    for name in ("vote_ratio", "psi_component", "ks_component", "prediction_component", "score", "threshold"):
        filled[name] = F.coalesce(name, F.lit(0.0))
    return rows.withColumns(filled)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return with_request_defaults(_csv_by_header(spark, path, REQUEST_SCHEMA))


def read_evaluated_requests(spark: SparkSession, path: str) -> DataFrame:
    """Only rows at which the detector ran; a log without the flag yields none."""
    rows = with_request_defaults(_csv_by_header(spark, path, REQUEST_SCHEMA), evaluated_default=0)
    return rows.filter("drift_evaluated = 1")


def read_resource_log(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv_by_header(spark, path, RESOURCE_SCHEMA)
    return rows.na.fill(0.0, ["process_cpu_percent"])


def read_feature_csv(
    spark: SparkSession,
    path: str,
    timestamp_col: str = "timestamp",
    label_col: str = "drift_label",
    pred_col: str | None = "pred_score",
    feature_cols: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Feature table and the feature columns: the given ones, else all that have no other role.

    Types follow the roles, so the files are read once: features and prediction are doubles, the label an
    integer, the time stays as it is written.
    """
    df = spark.read.option("header", True).csv(path)
    required = [timestamp_col, label_col, *([pred_col] if pred_col else [])]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    features = list(feature_cols or [c for c in df.columns if c not in required])
    if not features:
        raise ValueError("no feature columns")
    numbers = [F.col(c).try_cast("double").alias(c) for c in [*features, *([pred_col] if pred_col else [])]]
    label = F.col(label_col).try_cast("double").cast("int").alias(label_col)
    return df.select(timestamp_col, label, *numbers), features


def parse_scrape(lines: DataFrame, value: str = "value") -> DataFrame:
    """Metric scrape lines -> (metric, reading). Comments, labelled series and bad numbers drop."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    number = F.get(parts, F.lit(1)).try_cast("double")
    keep = ~F.col(value).startswith("#") & (F.size(parts) >= 2) & ~F.get(parts, F.lit(0)).contains("{")
    extra = [c for c in lines.columns if c != value]
    return lines.filter(keep).select(*extra, parts[0].alias("metric"), number.alias("reading")).filter("reading IS NOT NULL")


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """All scrape files under ``path``; the last reading of a metric in a file wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("line"))
    rows = parse_scrape(lines)
    return rows.groupBy("file", "metric").agg(
        F.max_by("reading", F.struct("block", "line")).alias("reading")
    )
