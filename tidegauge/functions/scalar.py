"""Scalar expressions on columns: ids, guards, scores, severities, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard and severity limits.
VALUE_LIMIT = 1e6
HIGH_SCORE, HIGH_MARGIN = 0.99, 0.10
MEDIUM_SCORE, MEDIUM_MARGIN = 0.95, 0.05
SAMPLE_SALT = "threshold-log-sample"


def stable_id(*parts: Column) -> Column:
    """First 24 hex digits of the sha-256 of all parts, each closed by a bar."""
    text = F.concat(*[F.concat(p.cast("string"), F.lit("|")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 24)


def hex_fraction(digest: Column, denominator: float) -> Column:
    """First eight hex digits of a digest as a share of ``denominator``."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(denominator)


def hash_sampled(id_col: Column, rate: float) -> Column:
    """Deterministic sample of ids at ``rate``; 1 and above keeps all, 0 and below none."""
    if rate >= 1.0:
        return F.lit(True)
    if rate <= 0.0:
        return F.lit(False)
    return hex_fraction(stable_id(F.lit(SAMPLE_SALT), id_col), float(0xFFFFFFFF)) < F.lit(rate)


def uniform(id_col: Column, salt: str) -> Column:
    """Repeatable uniform number in [0, 1) from a row id and a salt."""
    return hex_fraction(F.md5(F.concat(id_col.cast("string"), F.lit("|" + salt))), 4294967296.0)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _guard_sql(x: str) -> str:
    clipped = f"greatest(least({x}, {VALUE_LIMIT}D), -{VALUE_LIMIT}D)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0D ELSE {clipped} END"


def guard(x: str) -> Column:
    """NaN and null become 0, everything else is clipped to the value limit."""
    return F.expr(_guard_sql(x))


def vector_norm(cols: Sequence[str]) -> Column:
    """Euclidean norm of guarded columns."""
    return F.expr("sqrt(" + " + ".join(f"pow({_guard_sql(c)}, 2)" for c in cols) + ")")


def squash(raw: Column, mean: Column, std: Column) -> Column:
    """Sigmoid of the standardised raw score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw - mean) / (std + F.lit(1e-9))))


def severity(score: Column, threshold: Column) -> Column:
    high = F.least(F.lit(HIGH_SCORE), threshold + F.lit(HIGH_MARGIN))
    medium = F.least(F.lit(MEDIUM_SCORE), threshold + F.lit(MEDIUM_MARGIN))
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def damped(ratio: Column, cap: float) -> Column:
    """log(1 + ratio), floored at 0 and capped."""
    return F.least(F.log1p(F.greatest(F.lit(0.0), ratio)), F.lit(float(cap)))


def tag_present(tag: Column) -> Column:
    """Label rule of the evaluators: any tag, the empty one included."""
    return tag.isNotNull()


def tag_truthy(tag: Column) -> Column:
    """Label rule of the scorer: an empty tag is no label."""
    return tag.isNotNull() & (tag != F.lit(""))


def processing_lag(processed_s: Column, ingested_s: Column, event_s: Column) -> Column:
    """Seconds since ingest, or since the event where no ingest time is known; never negative."""
    return F.greatest(F.lit(0.0), processed_s - F.coalesce(ingested_s, event_s))


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))
