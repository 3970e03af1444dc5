from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.naive import edges_of, ks_frozen, psi_frozen
from tidegauge.functions import distance as D
from tidegauge.functions import scalar as S
from tidegauge.operators import profile, samples

RNG = np.random.default_rng(7)
SAMPLES = {
    "shift": (RNG.normal(0, 1, 2000), RNG.normal(2, 1, 2000)),
    "ties": (np.round(RNG.normal(0, 1, 500), 1), np.round(RNG.normal(0.3, 1, 400), 1)),
    "outside": (RNG.uniform(0, 1, 300), RNG.uniform(-1, 3, 300)),
    "constant": (np.full(100, 3.0), np.full(50, 3.0)),
    "few_values": (RNG.integers(0, 3, 400).astype(float), RNG.integers(0, 4, 300).astype(float)),
}


def long(spark, side):
    return spark.createDataFrame([(k, float(x)) for k, v in SAMPLES.items() for x in v[side]], "feature string, value double")


def by_feature(df):
    return {r.feature: r for r in df.collect()}


def test_bins_equal_numpy_histogram(spark):
    ref = long(spark, 0)
    edges = profile.decile_edges(ref, ["feature"])
    rows = long(spark, 1).join(edges, "feature").withColumn("bin", D.bin_of("value", "edges"))
    got = {(r.feature, r.bin): r["count"] for r in rows.groupBy("feature", "bin").count().collect()}
    for name, (r, c) in SAMPLES.items():
        want = np.histogram(c, bins=edges_of(r))[0]
        assert [got.get((name, i), 0) for i in range(1, 11)] == list(want)


def test_bins_leave_out_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (10.0,), (10.1,)], "v double")
    df = df.withColumn("e", F.array(*[F.lit(float(i)) for i in range(11)]))
    assert [r.b for r in df.select(D.bin_of("v", "e").alias("b")).collect()] == [0, 0, 1, 10, 0]


def test_widened_psi(spark):
    got = by_feature(samples.psi_widened(long(spark, 0), long(spark, 1), ["feature"]))
    for name, (r, c) in SAMPLES.items():
        q = np.quantile(r, np.linspace(0, 1, 11))
        q[0], q[-1] = min(q[0], c.min()) - 1e-9, max(q[-1], c.max()) + 1e-9
        a, b = (np.clip(np.histogram(x, bins=q)[0] / len(x), 1e-6, 1) for x in (r, c))
        assert got[name].psi == pytest.approx(float(np.sum((b - a) * np.log(b / a))), abs=1e-9)


def test_open_psi_ignores_non_finite_and_empty_is_zero(spark):
    ref, cur = long(spark, 0), long(spark, 1)
    odd = spark.createDataFrame([("shift", float("inf")), ("shift", float("nan")), ("none", float("nan"))], "feature string, value double")
    got = by_feature(samples.psi_open(ref, cur.unionByName(odd), ["feature"]))
    assert got["none"].psi == 0.0
    for name, (r, c) in SAMPLES.items():
        q = np.percentile(r, np.linspace(0, 100, 11))
        q[0], q[-1] = -np.inf, np.inf
        a, b = (np.histogram(x, bins=q)[0] / len(x) for x in (r, c))
        a, b = np.where(a == 0, 1e-6, a), np.where(b == 0, 1e-6, b)
        assert got[name].psi == pytest.approx(float(np.sum((b - a) * np.log(b / a))), abs=1e-9)


def test_exact_ks(spark):
    got = by_feature(samples.ks_distances(long(spark, 0), long(spark, 1), ["feature"], 0.01))
    for name, (r, c) in SAMPLES.items():
        r, c = np.sort(r), np.sort(c)
        grid = np.concatenate([r, c])
        d = np.max(np.abs(np.searchsorted(r, grid, "right") / len(r) - np.searchsorted(c, grid, "right") / len(c)))
        step = np.max(np.abs(np.searchsorted(r, c, "right") / len(r) - np.arange(1, len(c) + 1) / len(c)))
        assert got[name].ks == pytest.approx(d, abs=1e-12)
        assert got[name].ks_step == pytest.approx(step, abs=1e-12)
    assert got["shift"].triggered and not got["constant"].triggered
    assert got["constant"].p_value == 1.0


def test_ks_of_single_row_sample(spark):
    one = spark.createDataFrame([("x", 1.0)], "feature string, value double")
    many = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "feature string, value double")
    row = samples.ks_distances(many, one, ["feature"], 0.01).first()
    assert (row.ks_step, row.ks_critical, row.p_value, row.triggered) == (0.0, float("inf"), 1.0, False)


def test_profile_psi_grows_on_shift():
    r, c = SAMPLES["shift"]
    assert psi_frozen(r, c) > psi_frozen(r, r) and ks_frozen(r, c) > 0.5


def test_scalars(spark):
    row = spark.range(1).select(
        S.stable_id(F.lit("a"), F.lit("b")).alias("sid"),
        S.severity(F.lit(0.985), F.lit(0.9)).alias("m"),
        S.severity(F.lit(0.995), F.lit(0.9971)).alias("h"),
        S.hash_sampled(F.lit("x"), 1.0).alias("all"), S.hash_sampled(F.lit("x"), 0.0).alias("none"),
        S.damped(F.lit(-3.0), 3.0).alias("low"), S.damped(F.lit(1e9), 3.0).alias("cap"),
        S.processing_lag(F.lit(5.0), F.lit(None).cast("double"), F.lit(7.0)).alias("lag"),
    ).first()
    import hashlib

    assert row.sid == hashlib.sha256(b"a|b|").hexdigest()[:24]
    assert (row.m, row.h, row.all, row.none, row.low, row.cap, row.lag) == ("medium", "high", True, False, 0.0, 3.0, 0.0)


def test_uniform_draws_are_even(spark):
    rows = spark.range(20_000).select(S.uniform(F.col("id").cast("string"), "x").alias("u"))
    head = rows.agg(F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(head.m - 0.5) < 0.02 and 0 <= head.lo and head.hi < 1
