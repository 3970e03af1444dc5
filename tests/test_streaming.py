from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.naive import naive_features
from tidegauge.catalog import inputs as I
from tidegauge.catalog import streams  # noqa: F401  registers its queries
from tidegauge.catalog.queries import QUERIES
from tidegauge.config import FEATURES, FeatureConfig
from tidegauge.operators.features import entity_features
from tidegauge.plans.scoring import ScoringRun
from tidegauge.sources.events import parse_events, replay_stream
from tidegauge.streaming import entity_state, ingest, monitor

CFG = I.SMALL_CONFIG


@pytest.fixture(scope="module")
def run(spark, sf):
    ingest.use_state_store(spark)
    return ScoringRun(I.events(spark, sf), CFG)


def wire(rows):
    return rows.select(
        "event_id", (F.col("ts_us") / 1e6).alias("ts"), "entity_id", "amount", "merchant_id", "merchant_category",
        "country", "channel", "device_type", "drift_tag",
    )


def write_files(rows, path, parts):
    """The rows in event order, cut into ``parts`` files that arrive one after another."""
    ordered = rows.orderBy("ts_us").toPandas()
    size = -(-len(ordered) // parts)
    spark = rows.sparkSession
    for i in range(parts):
        part = spark.createDataFrame(ordered.iloc[i * size : (i + 1) * size], rows.schema)
        wire(part).coalesce(1).write.mode("append").json(path)


def feature_rows(df):
    return {r.event_id: tuple(round(r[f], 6) for f in FEATURES) for r in df.collect()}


def test_stream_features_equal_batch_with_duplicates_and_restart(spark, sf, run, tmp_path):
    rows = I.events(spark, sf)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    half = 1_705_000_000_000_000
    write_files(rows.filter(F.col("ts_us") < half), source, 2)
    # One stream per start: the second start continues from the checkpoint.
    for extra in (None, rows.filter(F.col("ts_us") >= half)):
        if extra is not None:
            write_files(extra.unionByName(rows.filter(F.col("ts_us").between(half - 3_600_000_000, half))), source, 1)
        stream = ingest.feature_stream(replay_stream(spark, source), CFG.features, "40 days")
        ingest.write_table(stream, out, state).awaitTermination()
    got = feature_rows(spark.read.parquet(out))
    want = feature_rows(entity_features(rows, CFG.features))
    assert len(got) == len(want) == rows.count()
    assert got == want


def test_monitor_stream_equals_batch(spark, sf, run, tmp_path):
    plain = run
    acts = spark.createDataFrame(
        [("main", 1_705_000_000_000_000, "freeze_adaptation", "ann", None), ("main", 1_705_600_000_000_000, "unfreeze_adaptation", None, None)],
        "stream_id string, ts_us long, action string, actor string, reason string",
    )
    run = ScoringRun(I.events(spark, sf), CFG, acts)
    for name in ("model", "features", "scored", "profile", "distances", "evaluations"):
        run.__dict__[name] = getattr(plain, name)
    assert run.thresholds.filter("changed AND ts_us BETWEEN 1705000000000000 AND 1705599999999999").isEmpty()
    assert run.thresholds.filter("changed").count() < plain.thresholds.filter("changed").count()
    base, source = str(tmp_path / "base"), str(tmp_path / "scored")
    columns = ["stream_id", "event_id", "ts_us", "entity_id", "merchant_category", "country", "channel", "score", *FEATURES]
    rows = run.scored.select(*columns)
    cuts = [0, 1_704_800_000_000_000, 1_705_500_000_000_000, 1 << 60]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows.filter((F.col("ts_us") >= a) & (F.col("ts_us") < b)).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        monitor.catch_up(spark, stream, base, CFG, run.profile, acts)
    decided = spark.read.parquet(f"{base}/decisions")
    got = {r.t: (round(r.drift_score, 9), round(r.drift_threshold, 9), r.drift_warning_active, r.drift_active, r.adwin_detected)
           for r in decided.filter(F.col("kind") == monitor.EVALUATION).collect()}
    want = {r.t: (round(r.drift_score, 9), round(r.drift_threshold, 9), r.drift_warning_active, r.drift_active, r.adwin_detected)
            for r in run.evaluations.collect()}
    assert got == want and len(want) > 10
    ticks = {r.t: round(r.threshold, 9) for r in decided.filter(F.col("kind") == monitor.TICK).collect()}
    assert ticks == {r.t: round(r.threshold, 9) for r in run.thresholds.collect()}
    alerts = spark.read.json(f"{base}/alerts")
    assert sorted(r.alert_id for r in alerts.collect()) == sorted(r.alert_id for r in run.alerts.collect())


def test_broker_stream_splits_dead_letters(spark, tmp_path):
    source = tmp_path / "broker"
    source.mkdir()
    good = '{"event_id":"a","ts":1.5,"entity_id":"e","amount":2,"merchant_id":"m","merchant_category":"c","country":"US","channel":"web"}'
    bad = [good.replace('"amount":2', '"amount":-2'), good.replace('"web"', '"fax"'), "{broken", good.replace('"ts":1.5,', "")]
    (source / "part-0.txt").write_text("\n".join([good, *bad]) + "\n")
    raw = spark.readStream.text(str(source))
    ok, dead = parse_events(raw)
    folders = [str(tmp_path / n) for n in ("good", "dead", "state")]
    for query in ingest.split_dead_letters(ok, dead, *folders):
        query.awaitTermination()
    event = spark.read.parquet(folders[0]).collect()
    assert [(e.event_id, e.ts_us, e.device_type) for e in event] == [("a", 1_500_000, "unknown")]
    reasons = sorted(r.reason for r in spark.read.parquet(folders[1]).collect())
    assert reasons == ["amount_negative", "channel_unknown", "malformed", "ts_missing"]


def test_late_rows_take_their_place(spark, tmp_path):
    ingest.use_state_store(spark)
    schema = "event_id string, ts double, entity_id string, amount double, merchant_id string, merchant_category string, country string, channel string, device_type string, drift_tag string"
    rows = [(f"e{i:02d}", 1000.0 + i, "x", float(10 + i % 7), f"m{i % 4}", "c", ("US", "IN", "CA")[i % 3], "web", "ios", None) for i in range(20)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:8] + rows[10:12], rows[8:10] + rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        stream = ingest.feature_stream(replay_stream(spark, source), FeatureConfig(window_seconds=6, max_events=8), "1 hour")
        ingest.write_table(stream, out, state).awaitTermination()
    got = feature_rows(spark.read.parquet(out))
    want = naive_features([(r[0], int(r[1] * 1e6), r[2], r[3], r[4], r[6]) for r in rows], 6, 8)
    # Rows after the late ones see them. The late rows themselves see what the state still holds:
    # one window back from the newest event.
    assert all(got[f"e{i:02d}"] == want[f"e{i:02d}"] for i in [*range(8), *range(12, 20)])
    assert len(got) == 20 and got["e08"][0] == 3.0


def test_refresh_freeze_and_restart_equal_the_batch_run(spark, sf, run, tmp_path):
    """Operator actions between and inside batches: versions, distances, states and thresholds as in one batch run."""
    acts = spark.createDataFrame(
        [("main", us, action, None, None) for us, action in (
            (1_704_900_000_000_000, "refresh_reference"), (1_705_000_000_000_000, "freeze_adaptation"), (1_705_450_000_000_000, "refresh_reference"),
            (1_705_450_000_000_001, "refresh_reference"), (1_705_600_000_000_000, "unfreeze_adaptation"), (1_706_000_000_000_000, "refresh_reference"))],
        "stream_id string, ts_us long, action string, actor string, reason string",
    )
    whole = ScoringRun(I.events(spark, sf), CFG, acts)
    for name in ("model", "features", "scored"):
        whole.__dict__[name] = getattr(run, name)
    base, source = str(tmp_path / "base"), str(tmp_path / "scored")
    rows = run.scored.select("stream_id", "event_id", "ts_us", "entity_id", "merchant_category", "country", "channel", "score", *FEATURES)
    cuts = [0, 1_704_800_000_000_000, 1_705_450_000_000_000, 1_705_460_000_000_000, 1 << 60]
    for a, b in zip(cuts, cuts[1:]):
        rows.filter((F.col("ts_us") >= a) & (F.col("ts_us") < b)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        monitor.catch_up(spark, stream, base, CFG, run.profile, acts)
    columns = ("t", "profile_id", "drift_warning_active", "drift_active", "adwin_detected")
    got, want = (
        {r.t: (*r[:5], round(r.drift_score, 9), round(r.drift_threshold, 9)) for r in df.select(*columns, "drift_score", "drift_threshold").collect()}
        for df in (spark.read.parquet(f"{base}/decisions").filter(F.col("kind") == monitor.EVALUATION), whole.evaluations)
    )
    assert got == want and {r[1] for r in want.values()} == {0, 1, 2}
    ticks = spark.read.parquet(f"{base}/decisions").filter(F.col("kind") == monitor.TICK)
    assert {r.t: round(r.threshold, 9) for r in ticks.collect()} == {r.t: round(r.threshold, 9) for r in whole.thresholds.collect()}
    assert sorted(r.alert_id for r in spark.read.json(f"{base}/alerts").collect()) == sorted(r.alert_id for r in whole.alerts.collect())
    # The state is a table, and another job starts from it.
    state = monitor.state_table(spark, base).collect()
    last = ticks.orderBy(F.desc("t")).first()
    assert [(s.stream_id, s.threshold_threshold) for s in state] == [("main", last.threshold)]
    assert len(state[0].drift_scores) == state[0].drift_learned > 0
    # Folders that a batch carries to the next do not pile up.
    import os

    assert all(len(os.listdir(f"{base}/{t}")) == 2 for t in ("ends", "tail", "versions", "thresholds"))


def test_monitor_starts_from_the_state_of_another(spark, sf, run, tmp_path):
    rows = run.scored.select("stream_id", "event_id", "ts_us", "entity_id", "merchant_category", "country", "channel", "score", *FEATURES)
    one, two, source = (str(tmp_path / n) for n in ("one", "two", "source"))
    rows.filter("t <= 500").coalesce(1).write.parquet(f"{source}1")
    monitor.catch_up(spark, spark.readStream.schema(rows.schema).parquet(f"{source}1"), one, CFG, run.profile)
    warm = monitor.state_table(spark, one)
    rows.filter("t > 500").coalesce(1).write.parquet(f"{source}2")
    monitor.catch_up(spark, spark.readStream.schema(rows.schema).parquet(f"{source}2"), two, CFG, run.profile, initial=warm)
    before = warm.first()
    after = monitor.state_table(spark, two).first()
    assert after.drift_learned > before.drift_learned > 0
    first = spark.read.parquet(f"{two}/decisions").filter(F.col("kind") == monitor.TICK).orderBy("t").first()
    assert first.threshold == before.threshold_threshold != CFG.control.initial_threshold


def _table(spark, path, rows, files):
    """Events as a table of ``files`` files that all span the whole time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(files, "event_id").write.parquet(f"{path}/events.parquet")


def test_stream_query_takes_the_files_of_an_arrival_together(spark, tmp_path):
    """Files that several tasks write side by side share their time; taken one after another, later ones miss windows."""
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(hours=7 * (i // 2)), (None, 1, 2)[i % 3], "view", None if i % 11 == 0 else float(i % 13), f'{{"k": {i % 40}}}')
        for i in range(180)
    ]
    _table(spark, tmp_path, rows, 3)
    found = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert found.rdd.getNumPartitions() > 1
    got, want = (
        {r.event_id: tuple(r)[1:] for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("st1_stream_features", "w1_entity_features")
    )
    assert len(got) == 180 and got == want


def test_entities_of_a_group_keep_windows_of_their_own(spark, tmp_path, monkeypatch):
    """Rows, kept and late ones, of many entities in one call, and state that is bounded by cap and window."""
    monkeypatch.setattr(entity_state, "GROUPS", 2)
    ingest.use_state_store(spark)
    schema = "event_id string, ts double, entity_id string, amount double, merchant_id string, merchant_category string, country string, channel string, device_type string, drift_tag string"
    rows = [(f"e{i:03d}", 1000.0 + i // 3, f"x{i % 7}", float(10 + i % 9), f"m{i % 4}", "c", ("US", "IN", "CA")[i % 3], "web", "ios", None) for i in range(210)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:70], rows[70:140], rows[140:]):
        spark.createDataFrame(part, schema).write.mode("append").json(source)
        stream = ingest.feature_stream(replay_stream(spark, source, files_per_trigger=None), FeatureConfig(window_seconds=20, max_events=6), "1 hour")
        ingest.write_table(stream, out, state).awaitTermination()
    want = naive_features([(r[0], int(r[1] * 1e6), r[2], r[3], r[4], r[6]) for r in rows], 20, 6)
    assert feature_rows(spark.read.parquet(out)) == want
