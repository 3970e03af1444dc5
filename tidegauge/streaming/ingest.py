"""Streaming ingest: validation, deduplication, features and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.config import FeatureConfig
from tidegauge.operators.models import FittedModel
from tidegauge.streaming.entity_state import stream_features

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_event_time(events: DataFrame, horizon: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", horizon)


def deduplicated(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """First arrival of each id within the horizon; later rows than the watermark drop."""
    return with_event_time(events, horizon).dropDuplicatesWithinWatermark(["event_id"])


def feature_stream(events: DataFrame, cfg: FeatureConfig, horizon: str = "1 hour") -> DataFrame:
    return stream_features(deduplicated(events, horizon), cfg)


def scored_stream(features: DataFrame, model: FittedModel) -> DataFrame:
    """Score a feature stream with a model fitted on a warm-up table (stream-static join)."""
    return model.transform(features)


def write_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options: str) -> StreamingQuery:
    """Exactly-once file sink; offsets and state live in the checkpoint folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    for name, option in options.items():
        writer = writer.option(name, option)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


class ReplacedBatches:
    """``foreachBatch`` sink of a source that is read at least once: offsets are committed after a batch is written, and
    a batch that comes again replaces itself, so every row is in the table once."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


def split_dead_letters(parsed_good: DataFrame, parsed_bad: DataFrame, good: str, bad: str, checkpoint: str) -> list[StreamingQuery]:
    """Two sinks for parsed broker values: events, and rejected values with their reason."""
    return [
        write_table(parsed_good, good, f"{checkpoint}/good"),
        write_table(parsed_bad, bad, f"{checkpoint}/dead"),
    ]
