from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordering as O


def skewed(spark, n=3000):
    """A third of all rows in one instant, another third in a short burst, ids with a long shared prefix."""
    rng = np.random.default_rng(3)
    ts = np.concatenate([np.full(n // 3, 500_000), rng.integers(700_000, 700_050, n // 3), rng.integers(0, 10**9, n - 2 * (n // 3))])
    return spark.createDataFrame([("main", f"event-{i:06d}", int(t)) for i, t in enumerate(ts)], "stream_id string, event_id string, ts_us long")


def test_index_equals_global_order_under_bursts_and_ties(spark):
    df = skewed(spark)
    got = {r.event_id: r.idx for r in O.event_index(df, target_rows=50).collect()}
    ordered = sorted(df.collect(), key=lambda r: (r.ts_us, r.event_id))
    assert got == {r.event_id: i + 1 for i, r in enumerate(ordered)}


def test_hot_ranges_and_ties_are_cut(spark):
    cut = O.slice_rows(skewed(spark), ["stream_id"], "ts_us", "event_id", 50)
    largest = cut.rows.groupBy("stream_id", *cut.columns).count().agg({"count": "max"}).first()[0]
    assert largest <= 50 * O.HOT_FACTOR * 2


def test_numeric_tie_column(spark):
    df = spark.range(1000).select(F.lit("main").alias("stream_id"), (F.col("id") * 7 % 1000).alias("event_id"), F.lit(5).cast("long").alias("ts_us"))
    got = {r.event_id: r.idx for r in O.event_index(df, target_rows=40).collect()}
    assert got == {i: i + 1 for i in range(1000)}


def test_running_totals_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [("ab"[int(i) % 2], float(v), int(w)) for i, (v, w) in enumerate(zip(rng.permutation(400), rng.integers(0, 5, 400)))]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {(r.g, r.v): r.s for r in O.running_totals(df, ["g"], ["v"], {"s": F.col("w")}, target_rows=20).collect()}
    for g in "ab":
        total = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            total += w
            assert got[g, v] == total


@pytest.mark.parametrize("target", [30, None])
def test_quantiles_equal_numpy(spark, target):
    rng = np.random.default_rng(5)
    data = {"a": rng.lognormal(3, 1, 501), "b": np.round(rng.normal(0, 1, 300), 1), "c": np.array([4.0])}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("a", float("nan")), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p37": 0.37, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in O.exact_quantiles(df, ["g"], "v", probs, target).collect()}
    for k, xs in data.items():
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(xs, p), abs=1e-9)


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert O.exact_quantiles(df, [], "v", {"p": 0.5}, 10).first().p == 50.0


def test_halo_copies_rows_forward_once(spark):
    df = spark.range(20).withColumnRenamed("id", "p")
    rows = O.with_halo(df, "p", 10, 3).collect()
    assert sorted((r.p, r._chunk) for r in rows if not r._core) == [(7, 1), (8, 1), (9, 1), (17, 2), (18, 2), (19, 2)]
    assert sum(r._core for r in rows) == 20


@pytest.mark.parametrize("options", [{}, {"salts": 4}, {"sparse_left": True}], ids=["plain", "salted", "sparse"])
def test_asof_carries_over_empty_chunks(spark, options):
    left = spark.createDataFrame([("s", t) for t in (1, 5, 50, 51, 999, 1000)], "k string, ts long")
    right = spark.createDataFrame([("s", 5, "a"), ("s", 50, "b"), ("s", 50, "c"), ("other", 1, "z")], "k string, ts long, v string")
    got = {r.ts: (r.v, r.right_ts) for r in O.asof_join(left, right, ["k"], "ts", 10, "v", **options).collect()}
    assert got == {1: (None, None), 5: ("a", 5), 50: ("c", 50), 51: ("c", 50), 999: ("c", 50), 1000: ("c", 50)}


def test_previous_row_over_range_borders(spark):
    df = spark.createDataFrame([("a", t, t * 2) for t in (1, 2, 35, 36, 99)] + [("b", 7, 0)], "k string, ts long, v long")
    got = {(r.k, r.ts): r._prev.v if r._prev else None for r in O.with_previous(df, ["k"], ["ts"], ["v"], 10).collect()}
    assert got == {("a", 1): None, ("a", 2): 2, ("a", 35): 4, ("a", 36): 70, ("a", 99): 72, ("b", 7): None}


def test_slices_planned_from_the_input_of_a_deduplication(spark):
    from tidegauge.operators.dedupe import first_per_id, opening_events

    raw = skewed(spark)
    doubled = raw.unionByName(raw).unionByName(raw.withColumn("ts_us", F.col("ts_us") + 1))
    got = {r.event_id: r.idx for r in O.event_index(first_per_id(doubled), target_rows=100, plan_from=doubled).collect()}
    want = {r.event_id: i + 1 for i, r in enumerate(sorted(raw.collect(), key=lambda r: (r.ts_us, r.event_id)))}
    assert got == want
    opening = {r.event_id: r.idx for r in opening_events(doubled, 400).collect()}
    assert opening == {e: i for e, i in want.items() if i <= 400}


def test_first_rows_order_a_bounded_part_only(spark):
    df = skewed(spark)
    want = [r.event_id for r in sorted(df.collect(), key=lambda r: (r.ts_us, r.event_id))]
    for n in (1, 60, 1100, 5000):
        got = O.first_rows(df, ["stream_id"], ("ts_us", "event_id"), n, target_rows=50)
        assert {r.event_id: r.idx for r in got.collect()} == {e: i + 1 for i, e in enumerate(want[:n])}
    plan = O.first_rows(df, ["stream_id"], ("ts_us", "event_id"), 60, target_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_odd_values_do_not_defeat_the_cuts(spark):
    """Infinities, NaN, far outliers and a heavy tie, alone and together."""
    rng = np.random.default_rng(8)
    plain = [float(x) for x in rng.normal(0, 1, 4000)]
    odd = [float("inf")] * 40 + [float("-inf")] * 40 + [float("nan")] * 40 + [1e300, -1e300, 1e-300] + [0.25] * 3000
    df = spark.createDataFrame([("a", x) for x in plain + odd], "g string, v double")
    cut = O.slice_rows(df, ["g"], "v", None, 50)
    sizes = cut.rows.groupBy("g", *cut.columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d")).collect()
    assert all(r.n <= 50 * O.HOT_FACTOR or r.d == 1 for r in sizes) and len(sizes) > 15
    want = sorted(x for x in plain + odd if x == x)
    for p in (0.0, 0.001, 0.3, 0.77, 1.0):
        got = O.exact_quantiles(df, ["g"], "v", {"p": p}, 50).first().p
        at = p * (len(want) - 1)
        lo, hi, f = want[int(np.floor(at))], want[int(np.ceil(at))], at - np.floor(at)
        assert got == (lo if f == 0 or lo == hi else pytest.approx(lo * (1 - f) + hi * f))


def test_top_quantile_may_be_infinite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "v double")
    row = O.exact_quantiles(df, [], "v", {"mid": 0.5, "top": 1.0}).first()
    assert row.mid == 2.0 and row.top == float("inf")
