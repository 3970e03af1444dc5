from __future__ import annotations


import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.naive import naive_features
from tidegauge.config import FEATURES, FeatureConfig
from tidegauge.operators import features

SCHEMA = "stream_id string, event_id string, ts_us long, entity_id string, amount double, merchant_id string, country string"


def frame(spark, rows):
    return spark.createDataFrame([("main", e, t, n, a, m, c) for e, t, n, a, m, c in rows], SCHEMA)


def collected(df):
    return {r.event_id: tuple(round(r[f], 6) for f in FEATURES) for r in df.collect()}


def series(n=25):
    s = 1_000_000
    return [(f"e{i:02d}", 1_700_000_000 * s + i * s, f"x{i % 3}", float(10 + i % 7), f"m{i % 4}", ("US", "IN", "CA")[i % 3]) for i in range(n)]


def test_matches_naive_windows(spark):
    cfg = FeatureConfig(window_seconds=6, max_events=8)
    assert collected(features.entity_features(frame(spark, series()), cfg)) == naive_features(series(), 6, 8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1), st.integers(1, 9), st.integers(0, 2)), min_size=1, max_size=40), st.integers(2, 6))
def test_ties_and_cap_match_naive(spark, items, cap):
    rows = [(f"e{i:03d}", t * 500_000, f"x{n}", float(a), f"m{m}", f"c{a % 2}") for i, (t, n, a, m) in enumerate(items)]
    cfg = FeatureConfig(window_seconds=2, max_events=cap, chunk_windows=1)
    assert collected(features.entity_features(frame(spark, rows), cfg)) == naive_features(rows, 2, cap)


def test_current_event_is_excluded_and_border_event_kept(spark):
    s = 1_000_000
    rows = [("a", 0, "x", 5.0, "m", "US"), ("b", 10 * s, "x", 7.0, "n", "US"), ("c", 10 * s + 1, "x", 9.0, "n", "IN")]
    got = collected(features.entity_features(frame(spark, rows), FeatureConfig(window_seconds=10)))
    assert got["a"] == (0.0,) * 8
    assert got["b"][:2] == (1.0, 5.0)
    assert got["c"][:2] == (1.0, 7.0)


@pytest.mark.parametrize("cap", [2, 4, 500])
def test_frames_equal_arrays_with_a_binding_cap_and_ties(spark, cap):
    cfg = FeatureConfig(window_seconds=6, max_events=cap)
    tied = [(f"{e}-again", t, *rest) for e, t, *rest in series()[::5]]
    for rows in (series(), series() + tied):
        df = frame(spark, rows)
        want = collected(features.entity_features(df, cfg))
        got = collected(features.entity_features_range(df, cfg))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_lag_mode_carries_across_days(spark):
    day = 86_400 * 1_000_000
    rows = [("a", 1, "x", 1.0, "m", "US"), ("b", 5 * day, "x", 1.0, "m", "US"), ("c", 5 * day + 2_000_000, "x", 1.0, "m", "US")]
    cfg = FeatureConfig(window_seconds=60, since_last="lag")
    got = {r.event_id: r.time_since_last for r in features.entity_features(frame(spark, rows), cfg).collect()}
    assert got["a"] == float("inf") and got["c"] == 2.0
    assert got["b"] == pytest.approx(5 * 86_400, abs=1e-3)


def test_hot_entity_spreads_over_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{i:05d}", int(t), "hot", 1.0, "m", "US") for i, t in enumerate(np.sort(rng.integers(0, 10**10, 3000)))]
    sliced = features._sliced(frame(spark, rows), FeatureConfig(window_seconds=60))
    largest = sliced.groupBy("entity_id", "_chunk").count().agg({"count": "max"}).first()[0]
    assert largest < 200
    assert sliced.filter("_core").count() == 3000


def test_windows_are_summed_in_batches_without_arrays(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i, t in enumerate(np.sort(rng.integers(0, 60, 400)).tolist()):
        amount = None if i % 37 == 0 else float(rng.normal()) * 10 ** float(rng.integers(0, 6))
        entity = None if i % 11 == 0 else f"x{i % 3}"
        rows.append((f"e{i:03d}" if i % 50 else None, t * 500_000, entity, amount, None if i % 5 == 0 else f"m{i % 4}", None if i % 13 == 0 else "US"))
    df = frame(spark, rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for cap in (3, 9, 500):
            cfg = FeatureConfig(window_seconds=8, max_events=cap)
            found = features.entity_features(df, cfg)
            plan = found._jdf.queryExecution().toString()
            assert "collect_list" not in plan and "Window" not in plan
            arrays = features.window_contents(df, cfg)
            n, total = F.size("window"), F.expr("aggregate(window, 0.0D, (a, x) -> a + x.amount)")
            mean = F.when(n > 0, total / n).otherwise(0.0)
            want = arrays.withColumns({"n": n, "total": total, "mean": mean}).select(
                "*",
                F.expr("aggregate(window, 0.0D, (a, x) -> a + (x.amount - mean) * (x.amount - mean))").alias("squares"),
                F.expr("size(array_distinct(transform(window, x -> x.merchant_id)))").alias("merchants"),
                F.expr("size(array_distinct(transform(window, x -> x.country)))").alias("countries"),
            )
            std = F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n"))).otherwise(0.0)
            want = want.select("event_id", "ts_us", "entity_id", F.col("n").cast("double"), "total", "mean", std, F.col("merchants").cast("double"), F.col("countries").cast("double"))
            got = found.select("event_id", "ts_us", "entity_id", "cnt_5m", "amt_sum_5m", "amt_mean_5m", "amt_std_5m", "uniq_merchant_5m", "uniq_country_5m")
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
