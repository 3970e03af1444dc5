from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalar as S
from tidegauge.operators import dedupe, inject, ops, phases, quality, windows


def flags(spark, rows):
    return spark.createDataFrame([(i, i * 1_000_000, a, d) for i, (a, d) in enumerate(rows)], "t long, ts_us long, alert boolean, drift boolean")


def test_alert_quality_with_and_without_labels(spark):
    rows = flags(spark, [(True, True), (True, False), (False, True), (False, False)])
    got = quality.alert_quality(rows, F.col("alert"), F.col("drift")).first()
    assert (got.alerts, got.tp, got.fp, got.fn, got.tn) == (2, 1, 1, 1, 1)
    assert (got.false_alert_rate, got.alert_rate_drift, got.alert_rate_non_drift) == (0.5, 0.5, 0.5)
    blind = quality.alert_quality(rows, F.col("alert"), None).first()
    assert blind.anomaly_rate == 0.5 and blind.fp is None and not blind.labels_available
    empty = quality.alert_quality(rows.limit(0), F.col("alert"), F.col("drift")).first()
    assert (empty.alerts, empty.anomaly_rate, empty.false_alert_rate) == (0, 0.0, 0.0)


def test_rates_are_zero_where_undefined(spark):
    got = quality.confusion(flags(spark, [(False, False)]), F.col("drift"), F.col("alert")).first()
    assert (got.precision, got.recall, got.f1, got.false_alert_rate) == (0.0, 0.0, 0.0, 0.0)


def test_delay_rules(spark):
    rows = flags(spark, [(True, False), (False, True), (False, True), (True, True)])
    early = quality.detection_delay(rows, "t", "ts_us", F.col("drift"), F.col("alert")).first()
    assert (early.events_to_detect, early.seconds_to_detect) == (0, 0.0)
    after = quality.detection_delay(rows, "t", "ts_us", F.col("drift"), F.col("alert"), after_onset=True).first()
    assert (after.events_to_detect, after.seconds_to_detect) == (2, 2.0)
    by_rate = quality.detection_delay(rows, "t", "ts_us", F.col("drift"), F.col("alert"), after_onset=True, events_per_sec=4.0).first()
    assert by_rate.seconds_to_detect == 0.5
    none = quality.detection_delay(rows, "t", "ts_us", F.lit(False), F.col("alert")).first()
    assert none.events_to_detect is None and none.seconds_to_detect is None


@pytest.mark.parametrize("chunk", [100_000, 4, 1])
def test_segments_over_chunk_borders(spark, chunk, monkeypatch):
    monkeypatch.setattr(quality, "RUN_CHUNK", chunk)
    truth = [0, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0, 1, 1]
    pred = [1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 0, 1, 0, 1, 0]
    rows = spark.createDataFrame([(i, i * 1_500_000, t, p) for i, (t, p) in enumerate(zip(truth, pred))], "i long, ts long, y int, p int")
    seg = quality.drift_segments(rows, "i", "ts", "y", "p")
    got = sorted((r.first_pos, r.last_pos, r.detected_pos, r.latency_s) for r in seg.collect())
    assert got == [(1, 2, 2, 1.5), (4, 9, 8, 6.0), (11, 11, None, None), (14, 15, 14, 0.0)]
    total = quality.segment_summary(seg).first()
    assert (total.segments_total, total.segments_detected, total.avg_latency_s) == (4, 3, 2.5)
    assert total.p95_latency_s == pytest.approx(5.55)
    assert quality.segment_summary(seg.filter("first_pos < 0")).first().p95_latency_s == 0.0


def test_gates(spark):
    row = spark.range(1).select(
        quality.hard_rate_gate(F.lit(0.05))[0].alias("a"), quality.hard_rate_gate(F.lit(0.051))[1].alias("b"),
        quality.target_rate_gate(F.lit(0.014), F.lit(0.01))[0].alias("c"), quality.target_rate_gate(F.lit(0.02), F.lit(0.01))[0].alias("d"),
        quality.target_rate_gate(F.lit(0.02), F.lit(0.01), blocked=F.lit(True))[1].alias("e"),
        quality.performance_gate(F.lit(100.0), F.lit(95.0), F.lit(2.0), F.lit(2.3))["performance_passed"].alias("f"),
        quality.sample_gate(F.lit(49), F.lit(True)).alias("g"),
        quality.fp_reduction(F.lit(0), F.lit(5)).alias("h"), quality.fp_reduction_floored(F.lit(0), F.lit(5)).alias("i"),
    ).first()
    assert row.a and row.b.startswith("FAIL") and row.c and not row.d and "waiver" in row.e
    assert row.f and not row.g and row.h == 0.0 and row.i == -500.0


def test_fallback_to_ok_rows(spark):
    rows = spark.createDataFrame([(200, 0), (302, 0), (404, 1), (500, 0)], "status_code int, drift_evaluated int")
    assert ops.evaluated_rows(rows).count() == 2
    more = rows.unionByName(rows.limit(1).withColumn("drift_evaluated", F.lit(1)))
    assert ops.evaluated_rows(more).count() == 1


def test_cpu_samples_of_short_and_resetting_logs(spark):
    rows = [("one", 1.0, 5.0, 2.0**20, 0.0), ("two", 0.0, 10.0, 2.0**20, 50.0), ("two", 2.0, 11.0, 3 * 2.0**20, 0.0), ("two", 4.0, 1.0, 2.0**20, 0.0)]
    df = spark.createDataFrame(rows, "host string, timestamp double, process_cpu_seconds_total double, process_resident_memory_bytes double, process_cpu_percent double")
    got = {r.host: r for r in ops.cpu_memory(df).collect()}
    assert (got["one"].cpu_avg_percent, got["one"].memory_avg_mb) == (0.0, 1.0)
    assert got["two"].cpu_avg_percent == 50.0 and got["two"].memory_avg_mb == pytest.approx(5 / 3)


def test_availability(spark):
    row = spark.range(1).select(*[ops.availability_percent(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("x", 100.0, 1.0), ("y", 0.0, 1.0), ("z", 10.0, 20.0), ("w", 10.0, -5.0))]).first()
    assert (row.x, row.y, row.z, row.w) == (99.0, 0.0, 0.0, 100.0)


def test_empty_series_summary(spark):
    df = spark.createDataFrame([], "idx long, p double")
    got = windows.series_summary(df, [], "idx", "p").first()
    assert (got.avg_ms, got.max_ms, got.latest_ms) == (None, None, None)


def test_trailing_alerts_include_the_border_and_ties(spark):
    times = [0, 10, 10, 60, 61, 130]
    df = spark.createDataFrame([("s", t * 1_000_000) for t in times], "k string, ts_us long")
    rates = windows.trailing_alert_rate(df, ["k"], 60)
    got = {r.ts_us // 1_000_000: (r.alerts_now, r.alerts_trailing) for r in rates.collect()}
    assert got == {0: (1, 1), 10: (2, 3), 60: (1, 4), 61: (1, 4), 130: (1, 1)}
    total = windows.alert_rate_summary(rates, ["k"], 3).first()
    assert total.max_alerts_per_minute == 4 and total.cap_breached
    assert total.avg_alerts_per_minute == pytest.approx((1 + 2 + 3 + 4 + 4 + 1) / 6)


def test_hot_id_collapses_before_the_shuffle(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"), F.col("id").alias("ts_us"),
        F.create_map(F.lit("a"), F.lit(1)).alias("extra"),
    )
    kept = dedupe.first_per_id(df)
    assert kept.count() == 2001 and kept.filter("event_id = 'hot'").first().ts_us == 0
    assert kept.columns == df.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_phase_progress_and_validation(spark):
    table = phases.phase_table(spark, [("a", 10, 0, "baseline"), ("b", 5, 1, "sudden")])
    rows = spark.createDataFrame([(-1.0,), (0.0,), (9.5,), (10.0,), (20.0,)], "s double")
    got = [(r.phase, r.ground_truth_drift, r.progress) for r in phases.label_phases(rows, "s", table).orderBy("s").collect()]
    assert got == [("a", 0, -0.1), ("a", 0, 0.0), ("a", 0, 0.95), ("b", 1, 0.0), ("b", 1, 1.0)]
    for bad in ([("a", 0, 0, "x")], [("a", 1, 2, "x")], []):
        with pytest.raises(ValueError):
            phases.phase_table(spark, bad)


def test_injection_rates_and_labels(spark):
    df = spark.range(20_000).select(
        F.col("id").cast("string").alias("event_id"), F.lit(1.0).alias("amount"), F.lit("fuel").alias("merchant_category"),
        F.lit("CA").alias("country"), F.lit(None).cast("string").alias("drift_tag"),
    )
    sudden = inject.inject(df, "sudden", F.lit(True))
    head = sudden.agg(F.avg("amount").alias("m"), F.avg((F.col("country") == "GB").cast("int")).alias("gb"), F.count("drift_tag").alias("n")).first()
    assert head.m == pytest.approx(0.7 * 2.5 + 0.3 * 1.25, abs=0.03) and head.gb == pytest.approx(4 / 9, abs=0.02) and head.n == 20_000
    burst = inject.inject(df, "bursty_entities", F.lit(True)).agg(F.avg((F.col("amount") == 12.0).cast("int"))).first()[0]
    assert burst == pytest.approx(0.03, abs=0.005)
    noisy = inject.inject(df, "noisy", F.lit(True))
    assert noisy.filter("drift_tag IS NOT NULL").isEmpty() and noisy.filter("amount <> 1.0").count() > 19_000
    with pytest.raises(ValueError):
        inject.inject(df, "unknown", F.lit(True))


def test_label_rules_differ_on_empty_tag(spark):
    row = spark.range(1).select(S.tag_present(F.lit("")).alias("a"), S.tag_truthy(F.lit("")).alias("b")).first()
    assert row.a and not row.b
