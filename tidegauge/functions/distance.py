"""Distribution distances as column expressions over binned counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.config import BINS

# Share floor and edge widening.
SHARE_FLOOR = 1e-6
EDGE_PAD = 1e-9


def bin_of(value: str, edges: str, bins: int = BINS) -> Column:
    """Bin 1..bins of a value: the last edge not above it, last bin closed; 0 when outside.

    ``value`` and ``edges`` are column references. Plain comparisons on array items, so it stays
    inside generated code. Repeated edges give empty bins.
    """
    passed = " + ".join(f"CAST({value} >= {edges}[{i}] AS INT)" for i in range(bins + 1))
    outside = f"{value} IS NULL OR isnan({value}) OR {value} < {edges}[0] OR {value} > {edges}[{bins}]"
    return F.expr(f"CASE WHEN {outside} THEN 0 ELSE least({passed}, {bins}) END")


def clipped_share(count: str, total: str) -> str:
    return f"least(greatest({count} / CAST(greatest(1, {total}) AS DOUBLE), {SHARE_FLOOR}D), 1D)"


def zero_floored_share(count: str, total: str) -> str:
    return f"CASE WHEN {count} = 0 THEN {SHARE_FLOOR}D ELSE {count} / CAST(greatest(1, {total}) AS DOUBLE) END"


def psi(cur: Sequence[str], ref: Sequence[str]) -> Column:
    """Population stability index of two lists of shares, given as array expressions' items.

    The shares are put into arrays first, so each is computed once.
    """
    terms = "zip_with(array({}), array({}), (c, r) -> (c - r) * ln(c / r))".format(", ".join(cur), ", ".join(ref))
    return F.expr(f"aggregate({terms}, 0D, (a, x) -> a + x)")


def ks_of_bins(counts: Sequence[str], total: str, ref: Sequence[str]) -> Column:
    """Largest gap between the two cumulated histograms."""
    gaps = []
    for i in range(1, len(counts) + 1):
        cum = f"({' + '.join(counts[:i])}) / CAST(greatest(1, {total}) AS DOUBLE)"
        gaps.append(f"abs(({' + '.join(ref[:i])}) - {cum})")
    return F.expr(f"greatest({', '.join(gaps)})")


def ks_critical(n_ref: Column, n_cur: Column, p: float) -> Column:
    """Critical distance at significance ``p``; infinite for samples under two rows."""
    alpha = max(1e-12, min(0.5, float(p)))
    scale = math.sqrt(-0.5 * math.log(alpha / 2.0))
    n, m = n_ref.cast("double"), n_cur.cast("double")
    return F.when((n < 2) | (m < 2), F.lit(float("inf"))).otherwise(
        F.lit(scale) * F.sqrt((n + m) / (n * m))
    )


def kolmogorov_p(d: Column, n_ref: Column, n_cur: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided p-value of a two-sample distance (Kolmogorov's series)."""
    n, m = n_ref.cast("double"), n_cur.cast("double")
    x = d * F.sqrt(n * m / (n + m))
    signs = F.expr(f"transform(sequence(1, {terms}), j -> named_struct('j', CAST(j AS DOUBLE), 's', IF(j % 2 = 1, 2D, -2D)))")
    series = F.aggregate(signs, F.lit(0.0), lambda a, t: a + t["s"] * F.exp(-2.0 * t["j"] * t["j"] * x * x))
    bounded = F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))
    # The alternating series does not settle near zero, where the p-value is 1.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(bounded)


def mean_shift(mean: Column, ref_mean: Column, ref_std: Column) -> Column:
    return F.abs(mean - ref_mean) / F.greatest(F.lit(1e-9), ref_std)
