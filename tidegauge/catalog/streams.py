"""Registered streaming queries: each runs streams to completion over files that arrive one after another, with a restart
from the checkpoint between them, and returns the tables they have written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import inputs as I
from tidegauge.catalog.queries import _broker_values, _features_out, _outcomes, _sharing, _wire, _with_copies, new_path, query, rounded
from tidegauge.config import FEATURES
from tidegauge.plans.scoring import ScoringRun
from tidegauge.sources.dumps import LineFiles
from tidegauge.sources.events import parse_events, replay_stream
from tidegauge.streaming import ingest, monitor

#: Instants at which the run's events are cut into the files of successive arrivals.
ARRIVALS = (I.RUN_START, I.RUN_START + 12 * 86_400 * I.US, I.MIDPOINT + 5 * 86_400 * I.US, 1 << 60)

_done: dict[tuple, str] = {}


def _once(spark: SparkSession, sf: str, name: str, make: Callable[[], str]) -> str:
    """Folder of a stream's tables, made once a session for all queries that read them."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _done:
        _done[key] = make()
    return _done[key]


def _arrivals(rows: DataFrame, edges=ARRIVALS) -> list[DataFrame]:
    return [rows.filter((F.col("ts_us") >= a) & (F.col("ts_us") < b)) for a, b in zip(edges, edges[1:])]


def _replayed(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame], None]) -> None:
    """Write rows as replay files, one arrival after another, and run a stream over them after each.

    The files of an arrival are written side by side and share its time, so they are one batch."""
    source = new_path(spark, "replay")
    for part in _arrivals(rows):
        part.select(_wire(part).alias("e")).select("e.*").write.mode("append").json(source)
        run(replay_stream(spark, source, files_per_trigger=None))


class Interrupted(Exception):
    """Raised by a sink to end a stream in the middle of a batch."""


@query
def s3_commit_after_processing(spark, sf):
    """Arrivals in the sink, by id, when a batch fails after its rows are written and before its offsets are: it is
    processed again, and the sink holds every arrival once."""
    out, state = new_path(spark, "committed"), new_path(spark, "state")
    sink = ingest.ReplacedBatches(out)
    failures = [1]

    def fragile(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id == 2 and failures:
            failures.pop()
            raise Interrupted

    def run(events: DataFrame) -> None:
        while True:
            stream = events.writeStream.foreachBatch(fragile).option("checkpointLocation", state).trigger(availableNow=True).start()
            try:
                return stream.awaitTermination()
            except Exception:
                if "Interrupted" not in str(stream.exception()):
                    raise

    _replayed(spark, _with_copies(spark, sf).drop("source"), run)
    return spark.read.parquet(out).groupBy("event_id").agg(F.count(F.lit(1)).alias("arrivals"), F.round(F.sum("amount"), 6).alias("amount"))


def _lines(spark: SparkSession, values: DataFrame) -> str:
    """Folder with values as lines of files that are read in the order of their names."""
    folder = new_path(spark, "lines")
    values.write.text(folder)
    return folder


def _moved(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Files of ``source`` moved into ``folder``, their names behind ``name``."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(paths(folder))
    for found in files.listStatus(paths(source)):
        if found.getPath().getName().startswith("part-"):
            files.rename(found.getPath(), paths(f"{folder}/{name}-{found.getPath().getName()}"))


@query
def s1_line_files(spark, sf):
    """Replay files through the data source of line files, in ranges of bytes."""
    spark.dataSource.register(LineFiles)
    rows = I.events(spark, sf)
    folder = _lines(spark, rows.select(F.to_json(_wire(rows), {"ignoreNullFields": "false"}).alias("value")))
    good, _ = parse_events(spark.read.format("line_files").option("rangeBytes", str(256 << 10)).load(folder))
    return good.select("event_id", "ts_us", "entity_id", F.round("amount", 6).alias("amount"), "country", "device_type", "drift_tag")


@query
def s2_dump_stream(spark, sf):
    """A broker dump that grows, as a stream: events and dead letters, with a restart from the offsets."""
    spark.dataSource.register(LineFiles)
    values, folder, tables = _broker_values(spark, sf), new_path(spark, "lines"), new_path(spark, "dump")
    for half in (0, 1):
        # Segments of the dump: names rise from one arrival to the next.
        part = values.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == half)
        part.write.mode("overwrite").text(f"{folder}-{half}")
        _moved(spark, f"{folder}-{half}", folder, f"segment-{half}")
        raw = spark.readStream.format("line_files").option("rangeBytes", str(256 << 10)).load(folder)
        for stream in ingest.split_dead_letters(*parse_events(raw), f"{tables}/good", f"{tables}/dead", f"{tables}/state"):
            stream.awaitTermination()
    return _outcomes(spark.read.parquet(f"{tables}/good"), spark.read.parquet(f"{tables}/dead"))


@query
def st1_stream_features(spark, sf):
    ingest.use_state_store(spark)
    out, state = new_path(spark, "features"), new_path(spark, "state")

    def run(events: DataFrame) -> None:
        ingest.write_table(ingest.feature_stream(events, I.CONFIG.features, "40 days"), out, state).awaitTermination()

    _replayed(spark, I.events(spark, sf), run)
    return _features_out(spark.read.parquet(out))


@query
def st2_stream_dedupe(spark, sf):
    """Copies of an event agree in these columns, so it does not matter which of one batch passes."""
    ingest.use_state_store(spark)
    out, state = new_path(spark, "deduplicated"), new_path(spark, "state")

    def run(events: DataFrame) -> None:
        ingest.write_table(ingest.deduplicated(events, "40 days"), out, state).awaitTermination()

    _replayed(spark, _with_copies(spark, sf).drop("source"), run)
    return spark.read.parquet(out).select("event_id", "entity_id", "merchant_id", "country", "channel")


def _monitored(spark: SparkSession, sf: str, name: str, edges=ARRIVALS, controls: DataFrame | None = None) -> str:
    """Folder of a monitor that has seen the scored rows of the run, one arrival after another."""

    def make() -> str:
        ingest.use_state_store(spark)
        run, base, source = I.run(spark, sf), new_path(spark, "monitor"), new_path(spark, "scored")
        rows = run.scored.select("stream_id", "event_id", "ts_us", "entity_id", "merchant_category", "country", "channel", "score", *FEATURES)
        for part in _arrivals(rows, edges):
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).parquet(source)
            monitor.catch_up(spark, stream, base, I.CONFIG, run.profile, controls)
        return base

    return _once(spark, sf, name, make)


def _evaluations(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/decisions").filter(F.col("kind") == monitor.EVALUATION)
    u = F.col("t") - I.CONFIG.drift.reference_events
    return rows.select(u.alias("u"), "profile_id", "drift_score", "drift_threshold", "vote_ratio", "drift_warning_active", "drift_active")


def _thresholds(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/decisions").filter(F.col("kind") == monitor.TICK).select("t", "threshold", "changed")


@query
def st3_micro_batches(spark, sf):
    """Thresholds of a monitor that saw all rows in one batch, beside those of one that saw several."""
    one = _thresholds(spark, _monitored(spark, sf, "one", (0, 1 << 60)))
    many = _thresholds(spark, _monitored(spark, sf, "many")).withColumnsRenamed({"threshold": "in_batches", "changed": "changed_in_batches"})
    return rounded(one.join(many, "t", "full"))


@query
def st4_state_after_restart(spark, sf):
    """State of the monitor after its last restart, read from the checkpoint."""
    state = monitor.state_table(spark, _monitored(spark, sf, "many"))
    return rounded(
        state.select(
            "stream_id", F.col("threshold_threshold").alias("threshold"), F.col("threshold_changed_us").alias("changed_us"),
            F.col("threshold_logged").alias("logged"), F.col("threshold_logged_us").alias("logged_us"),
            F.col("drift_learned").alias("learned"), F.aggregate("drift_scores", F.lit(0.0), lambda a, x: a + x).alias("score_sum"),
            F.col("drift_warning").alias("warning"), F.col("drift_critical").alias("critical"),
        ),
        5,
    )


@query
def st5_stream_alerts(spark, sf):
    alerts = spark.read.json(f"{_monitored(spark, sf, 'many')}/alerts")
    return rounded(alerts.select("event_id", "ts_us", "threshold", "severity"), 5)


@query
def st6_stream_decisions(spark, sf):
    return rounded(_evaluations(spark, _monitored(spark, sf, "many")).drop("profile_id"), 5)


@query
def st6_stream_thresholds(spark, sf):
    return rounded(_thresholds(spark, _monitored(spark, sf, "many")))


@query
def st6_controlled_decisions(spark, sf):
    """Evaluations while operators refresh the reference again and again."""
    return rounded(_evaluations(spark, _monitored(spark, sf, "controlled", controls=I.controls(spark, sf))), 5)


@query
def st6_controlled_thresholds(spark, sf):
    """Thresholds while operators freeze, release and refresh."""
    return rounded(_thresholds(spark, _monitored(spark, sf, "controlled", controls=I.controls(spark, sf))))


@query
def t9_refreshed_states(spark, sf):
    """Drift states of a batch run in which operators refresh the reference."""
    rows = _refreshed(spark, sf).evaluations
    return rounded(rows.select("u", "profile_id", "drift_score", "drift_threshold", "vote_ratio", "drift_warning_active", "drift_active"), 5)


@query
def t9_refreshed_thresholds(spark, sf):
    return rounded(_refreshed(spark, sf).thresholds.select("t", "threshold", "changed"))


def _refreshed(spark: SparkSession, sf: str) -> ScoringRun:
    run = ScoringRun(I.events(spark, sf), I.CONFIG, I.controls(spark, sf))
    return _sharing(I.run(spark, sf), run, "model", "features", "scored")
