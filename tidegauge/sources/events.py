"""Event sources: table mapping, JSONL replay, broker payloads, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event fields and their allowed values.
CHANNELS = ("web", "mobile", "pos")
DEVICE_TYPES = ("ios", "android", "desktop", "unknown")
COUNTRIES = ("US", "IN", "CA", "GB", "AU")
REQUIRED = ("event_id", "ts", "entity_id", "amount", "merchant_id", "merchant_category", "country", "channel")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("drift_tag", T.StringType()),
    ]
)
DEFAULT_STREAM = "main"


def micros(ts: Column, dtype: str) -> Column:
    """Epoch microseconds of a timestamp of either kind, whatever the session time zone."""
    if dtype == "timestamp_ntz":
        origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", origin, ts)
    return F.unix_micros(ts)


def _one_of(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % F.lit(len(values)) + 1).cast("int"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the shape the engine works on, without drift labels."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        F.lit(DEFAULT_STREAM).alias("stream_id"),
        F.col("event_id").cast("string").alias("event_id"),
        micros(F.col("ts"), dict(raw.dtypes)["ts"]).alias("ts_us"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("value").alias("amount"),
        k.cast("string").alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        _one_of(COUNTRIES, k).alias("country"),
        _one_of(CHANNELS, k).alias("channel"),
        _one_of(DEVICE_TYPES, k).alias("device_type"),
        F.lit(None).cast("string").alias("drift_tag"),
    )


def normalized(events: DataFrame, stream: Column | None = None) -> DataFrame:
    """Float-second events with ``ts_us`` and ``stream_id`` in place of ``ts``."""
    stream = F.lit(DEFAULT_STREAM) if stream is None else stream
    fields = [f.name for f in EVENT_SCHEMA if f.name != "ts"]
    return events.select(
        stream.alias("stream_id"),
        "event_id",
        F.round(F.col("ts") * 1e6).cast("long").alias("ts_us"),
        *fields[1:],
    )


def rejection(ts_col: str = "ts") -> Column:
    """Name of the first broken rule of an event row, null when it is valid."""
    checks = F.lit(None).cast("string")
    rules = [(f"{c}_missing", F.col(ts_col if c == "ts" else c).isNull()) for c in REQUIRED]
    rules += [
        ("amount_negative", F.isnan("amount") | (F.col("amount") < 0)),
        ("channel_unknown", ~F.col("channel").isin(*CHANNELS)),
        ("device_type_unknown", ~F.col("device_type").isin(*DEVICE_TYPES)),
    ]
    for reason, broken in reversed(rules):
        checks = F.when(broken, F.lit(reason)).otherwise(checks)
    return checks


def validate(events: DataFrame, ts_col: str = "ts_us") -> tuple[DataFrame, DataFrame]:
    """Valid rows with defaults filled in, and rejected rows with a reason."""
    rows = events.withColumn("device_type", F.coalesce("device_type", F.lit("unknown")))
    rows = rows.withColumn("reason", rejection(ts_col))
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def parse_events(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Broker values -> (events, dead letters). Works on batches and streams of any source.

    Fields are read as text and cast, so one bad field marks its row only. The reason leaves through a generator:
    Spark would put it into the filters on it and there parse a value again for every field of every rule.
    """
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in EVENT_SCHEMA])
    text = F.col(value).cast("string")
    rows = df.select("*", F.from_json(text, text_schema).alias("_e"), F.json_object_keys(text).alias("_keys"))
    null_device = F.array_contains("_keys", "device_type") & F.col("_e.device_type").isNull()
    fields = {
        f.name: (F.col(f"_e.{f.name}").try_cast("double") if f.dataType == T.DoubleType() else F.col(f"_e.{f.name}"))
        for f in EVENT_SCHEMA
    }
    fields["device_type"] = F.coalesce("_e.device_type", F.lit("unknown"))
    rows = rows.withColumns(fields)
    reason = (
        F.when(F.col("_e").isNull() | F.col("_keys").isNull(), "malformed")
        .when(null_device, "device_type_missing")
        .otherwise(rejection())
    )
    rows = rows.select("*", F.explode(F.array(reason)).alias("reason")).drop("_e", "_keys")
    good = normalized(rows.filter("reason IS NULL"))
    return good, rows.filter("reason IS NOT NULL").select(text.alias("value"), "reason")


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines replay files; original times are kept."""
    return normalized(spark.read.schema(EVENT_SCHEMA).json(path))


def replay_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Replay files as a stream, a batch of ``files_per_trigger`` files after another, or all new files at once if None."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalized(reader.json(path))


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw broker rows for ``parse_events``; needs the Spark Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", "earliest")
    for name, option in options.items():
        reader = reader.option(name, option)
    return reader.load()


def label_integrity(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: number of lines and whether every line carries the label key, null counting."""
    has_key = F.coalesce(F.array_contains(F.json_object_keys(value), "drift_tag"), F.lit(False))
    return lines.agg(
        F.count(F.lit(1)).alias("lines_total"),
        F.coalesce(F.bool_and(has_key), F.lit(True)).alias("drift_tag_present_all"),
    )


def load_replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Replay events and their label-integrity row; an empty replay is an error."""
    lines = spark.read.text(path)
    if lines.isEmpty():
        raise ValueError(f"replay has no events: {path}")
    return read_replay(spark, path), label_integrity(lines)
