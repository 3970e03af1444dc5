"""Drift injected into existing tables, repeatable because chance comes from the row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import uniform

# Categories and drift strengths.
CATEGORIES = ("grocery", "fuel", "electronics", "fashion", "pharmacy", "travel", "food")
NEW_CATEGORIES = ("crypto_exchange", "gaming")
NEW_CATEGORY_WEIGHTS = (1, 1, 1, 1, 1, 1, 1, 0.8, 0.8)
MEAN_SHIFT = 2.0
BURST, BURST_RATE = 12.0, 0.03
GRADUAL_GAIN, TRAVEL_BASE, TRAVEL_GAIN = 1.4, 0.15, 0.25
SUDDEN_STRONG, SUDDEN_WEAK, SUDDEN_SHARE = 2.5, 1.25, 0.7
SUDDEN_COUNTRIES, SUDDEN_COUNTRY_WEIGHTS = ("US", "GB", "AU", "IN"), (1, 4, 3, 1)
SUDDEN_CATEGORIES, SUDDEN_CATEGORY_WEIGHTS = ("electronics", "travel", "fashion", "food"), (4, 4, 2, 1)
NOISE, NOISE_SPIKE, NOISE_SPIKE_RATE = 0.45, 5.0, 0.01
PATTERNS = ("baseline", "mean_shift_amount", "bursty_entities", "new_category", "gradual", "sudden", "noisy")
LABELLED = ("mean_shift_amount", "bursty_entities", "new_category", "gradual", "sudden")


def weighted_choice(u: Column, values: Sequence[str], weights: Sequence[float]) -> Column:
    """Value picked by a uniform number in proportion to the weights."""
    total = float(sum(weights))
    picked = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        picked = F.when(u < F.lit(sum(weights[: i + 1]) / total), F.lit(values[i])).otherwise(picked)
    return picked


def inject(
    events: DataFrame, pattern: str, where: Column, progress: Column | None = None, seed: int = 42, tag: str | None = None
) -> DataFrame:
    """Apply one pattern to the rows of ``where``; drifted rows get ``drift_tag``.

    ``progress`` (0..1 through the segment) drives the gradual pattern.
    """
    if pattern not in PATTERNS:
        raise ValueError(f"unknown drift pattern: {pattern}")
    p = F.lit(1.0) if progress is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))

    def draw(name: str) -> Column:
        return uniform(F.col("event_id"), f"{seed}-{name}")

    amount, category, country = F.col("amount"), F.col("merchant_category"), F.col("country")
    if pattern == "mean_shift_amount":
        amount = amount * MEAN_SHIFT
    elif pattern == "bursty_entities":
        amount = F.when(draw("burst") < BURST_RATE, amount * BURST).otherwise(amount)
    elif pattern == "new_category":
        category = weighted_choice(draw("category"), [*CATEGORIES, *NEW_CATEGORIES], NEW_CATEGORY_WEIGHTS)
    elif pattern == "gradual":
        amount = amount * (F.lit(1.0) + GRADUAL_GAIN * p)
        category = F.when(draw("travel") < TRAVEL_BASE + TRAVEL_GAIN * p, F.lit("travel")).otherwise(category)
    elif pattern == "sudden":
        amount = amount * F.when(draw("strength") < SUDDEN_SHARE, SUDDEN_STRONG).otherwise(SUDDEN_WEAK)
        country = weighted_choice(draw("country"), SUDDEN_COUNTRIES, SUDDEN_COUNTRY_WEIGHTS)
        category = weighted_choice(draw("category"), SUDDEN_CATEGORIES, SUDDEN_CATEGORY_WEIGHTS)
    elif pattern == "noisy":
        noisy = amount * (F.lit(1.0 - NOISE) + 2 * NOISE * draw("noise"))
        amount = F.when(draw("spike") < NOISE_SPIKE_RATE, noisy * NOISE_SPIKE).otherwise(noisy)
    mark = F.lit(tag or pattern) if pattern in LABELLED else F.col("drift_tag")
    return events.withColumns(
        {
            "amount": F.when(where, amount).otherwise(F.col("amount")),
            "merchant_category": F.when(where, category).otherwise(F.col("merchant_category")),
            "country": F.when(where, country).otherwise(F.col("country")),
            "drift_tag": F.when(where, mark).otherwise(F.col("drift_tag")),
        }
    )


def shift_columns(df: DataFrame, where: Column, changes: dict[str, dict[str, float]], label: str = "drift_label") -> DataFrame:
    """Scale, offset and clip numeric columns on a segment and label it.

    ``changes``: column -> {"scale": s, "offset": o, "low": l, "high": h}, each optional.
    """
    out = {}
    for name, change in changes.items():
        value = F.col(name) * F.lit(change.get("scale", 1.0)) + F.lit(change.get("offset", 0.0))
        if "low" in change:
            value = F.greatest(value, F.lit(change["low"]))
        if "high" in change:
            value = F.least(value, F.lit(change["high"]))
        out[name] = F.when(where, value).otherwise(F.col(name))
    known = F.col(label) if label in df.columns else F.lit(0)
    out[label] = F.when(where, F.lit(1)).otherwise(known)
    return df.withColumns(out)
