"""Two-sample comparison of any two row sets, keyed and distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import BINS
from tidegauge.functions import distance as D
from tidegauge.functions.scalar import is_finite
from tidegauge.operators.ordering import exact_quantiles, running_totals
from tidegauge.operators.profile import DECILES, bin_counts, count_names, total_of
from tidegauge.session import small, stage

Q = [f"q{i}" for i in range(BINS + 1)]


def _deciles(ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    return exact_quantiles(ref, keys, "value", dict(zip(Q, DECILES, strict=True)))


def _binned(sample: DataFrame, edges: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    rows = sample.join(small(edges), list(keys)).withColumn("bin", D.bin_of("value", "edges"))
    counted = rows.groupBy(*keys).agg(*bin_counts(), F.count("value").alias("n"))
    return counted.select(
        *keys, F.col("n").alias(f"n_{prefix}"), *[F.col(b).alias(p) for b, p in zip(count_names(), count_names(prefix), strict=True)]
    )


def _shares(prefix: str, rule, total: str) -> list[str]:
    return [rule(c, total) for c in count_names(prefix)]


def psi_widened(ref: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI on reference deciles whose outer edges are stretched over both samples."""
    keys = list(keys)
    span = cur.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    edges = _deciles(ref, keys).join(small(span), keys)
    edges = edges.select(
        *keys,
        F.array(
            F.least("q0", "_lo") - D.EDGE_PAD, *[F.col(q) for q in Q[1:-1]],
            F.greatest(F.col(Q[-1]), F.col("_hi")) + D.EDGE_PAD,
        ).alias("edges"),
    )
    both = _binned(ref, edges, keys, "r").join(_binned(cur, edges, keys, "c"), keys)
    value = D.psi(_shares("c", D.clipped_share, total_of("c")), _shares("r", D.clipped_share, total_of("r")))
    return both.select(*keys, "n_r", "n_c", value.alias("psi"))


def psi_verdict(distances: DataFrame, threshold: float) -> DataFrame:
    return distances.withColumn("triggered", F.col("psi") >= threshold)


def open_edges(deciles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner deciles between infinite ends."""
    inf = F.lit(float("inf"))
    return deciles.select(*keys, F.array(-inf, *[F.col(c) for c in Q[1:-1]], inf).alias("edges"))


def psi_open(ref: DataFrame, cur: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI with infinite outer edges over finite rows; 0 where a sample has none."""
    keys = list(keys)
    finite = is_finite(F.col("value"))
    edges = open_edges(_deciles(ref.filter(finite), keys), keys)
    counted = _binned(ref.filter(finite), edges, keys, "r").join(_binned(cur.filter(finite), edges, keys, "c"), keys)
    value = D.psi(
        _shares("c", D.zero_floored_share, "n_c"), _shares("r", D.zero_floored_share, "n_r")
    )
    groups = ref.select(*keys).distinct().unionByName(cur.select(*keys).distinct()).distinct()
    return groups.join(counted.select(*keys, value.alias("psi")), keys, "left").na.fill(0.0, ["psi"])


def ks_distances(ref: DataFrame, cur: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """Exact two-sample distance, its one-sided-step variant, critical value and asymptotic p.

    Equal values are counted first, then one distributed running count over the merged values
    gives both distribution functions at every point; nothing is sorted in one task.
    """
    keys = list(keys)
    merged = (
        ref.select(*keys, "value", F.lit(1).alias("r"), F.lit(0).alias("c"))
        .unionByName(cur.select(*keys, "value", F.lit(0).alias("r"), F.lit(1).alias("c")))
        .groupBy(*keys, "value")
        .agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    )
    merged = stage(merged, "merged")
    cum = running_totals(merged, keys, ["value"], {"cum_r": F.col("r"), "cum_c": F.col("c")})
    sizes = merged.groupBy(*keys).agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    if keys:
        rows = cum.join(small(sizes), keys)
    else:
        rows = cum.select("*", sizes.select("n").scalar().alias("n"), sizes.select("m").scalar().alias("m"))
    at_ref = F.col("cum_r") / F.col("n")
    gap = F.abs(at_ref - F.col("cum_c") / F.col("m"))
    # Ties of the current sample keep their own ranks: the farthest are the first and the last.
    first_rank = (F.col("cum_c") - F.col("c") + 1) / F.col("m")
    step_gap = F.when(F.col("c") > 0, F.greatest(F.abs(at_ref - first_rank), gap))
    out = rows.groupBy(*keys).agg(
        F.first("n").alias("n_ref"), F.first("m").alias("n_cur"), F.max(gap).alias("_d"), F.max(step_gap).alias("_s")
    )
    enough = (F.col("n_ref") >= 2) & (F.col("n_cur") >= 2)
    return out.select(
        *keys, "n_ref", "n_cur",
        F.when(enough, F.col("_d")).alias("ks"),
        F.when(enough, F.col("_s")).otherwise(F.lit(0.0)).alias("ks_step"),
        D.ks_critical(F.col("n_ref"), F.col("n_cur"), p).alias("ks_critical"),
        F.when(enough, D.kolmogorov_p(F.col("_d"), F.col("n_ref"), F.col("n_cur"))).otherwise(F.lit(1.0)).alias("p_value"),
    ).withColumn("triggered", enough & (F.col("p_value") < p))
