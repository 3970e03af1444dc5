"""Adaptive windowing change detection on block summaries (Bifet and Gavalda, 2007)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.folding import Step, ordered_fold

# Buckets per size class and the smallest side of a cut.
MAX_BUCKETS = 5
MIN_SIDE = 5
GRACE = 10

CHANGE_SCHEMA = "stream_id string, t long, adwin_detected boolean, window_rows long, window_mean double"


class AdaptiveWindow:
    """Window over (count, mean, squared deviation) buckets; logarithmic in its length."""

    FIELDS = {"sizes": "array<long>", "buckets": "array<double>"}

    def __init__(self, delta: float) -> None:
        self.delta = delta
        # levels[i]: buckets of 2**i merged blocks, oldest first; the last level is the oldest.
        self.levels: list[list[tuple[float, float, float]]] = [[]]
        # Merged buckets from the oldest on, and how many of them still hold.
        self._sums: tuple[list[float], list[float], list[float]] = ([], [], [])
        self._known = 0

    @staticmethod
    def _merge(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float]:
        n = a[0] + b[0]
        if n == 0:
            return (0.0, 0.0, 0.0)
        gap = b[1] - a[1]
        return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n)

    def dump(self) -> dict:
        """Buckets a level, and the buckets of all levels laid end to end."""
        return {"sizes": [len(level) for level in self.levels], "buckets": [float(x) for level in self.levels for b in level for x in b]}

    def load(self, state: dict) -> None:
        values = [float(x) for x in state["buckets"]]
        buckets = list(zip(values[::3], values[1::3], values[2::3], strict=True))
        self.levels = []
        for size in state["sizes"]:
            self.levels.append(buckets[: int(size)])
            buckets = buckets[int(size) :]
        self._known = 0

    def _prefix(self) -> tuple[list[float], list[float], list[float]]:
        """Counts, means and squared deviations of the oldest bucket, the two oldest, and so on.

        What the untouched levels give is kept from one block to the next: a level changes half as often as the
        one below it.
        """
        known, (counts, means, squares) = self._known, self._sums
        del counts[known:], means[known:], squares[known:]
        n, mean, square = (counts[-1], means[-1], squares[-1]) if known else (0.0, 0.0, 0.0)
        for level in reversed(self.levels):
            if known >= len(level):
                known -= len(level)
                continue
            for size, m, s in level[known:]:
                whole = n + size
                if whole == 0:
                    n, mean, square = 0.0, 0.0, 0.0
                else:
                    gap = m - mean
                    n, mean, square = whole, mean + gap * size / whole, square + s + gap * gap * n * size / whole
                counts.append(n)
                means.append(mean)
                squares.append(square)
            known = 0
        self._known = len(counts)
        return self._sums

    @property
    def total(self) -> tuple[float, float, float]:
        counts, means, squares = self._prefix()
        return (counts[-1], means[-1], squares[-1]) if counts else (0.0, 0.0, 0.0)

    def _drop_oldest(self) -> None:
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()
        self.levels[-1].pop(0)
        self._known = 0

    def _cut_found(self) -> bool:
        counts, means, squares = self._prefix()
        n = counts[-1] if counts else 0.0
        if n <= GRACE:
            return False
        variance = squares[-1] / n
        confidence = math.log(2.0 * math.log(n) / self.delta)
        n0, mean0 = np.array(counts[:-1]), np.array(means[:-1])
        n1 = n - n0
        sides = (n0 >= MIN_SIDE) & (n1 >= MIN_SIDE)
        if not sides.all():
            n0, mean0, n1 = n0[sides], mean0[sides], n1[sides]
        mean1 = (n * means[-1] - n0 * mean0) / n1
        inverse = 1.0 / n0 + 1.0 / n1
        bound = np.sqrt(2.0 * inverse * variance * confidence) + 2.0 / 3.0 * inverse * confidence
        return bool((np.abs(mean0 - mean1) > bound).any())

    def add(self, n: float, mean: float, squares: float) -> bool:
        """Append one block; True when older blocks were dropped because the mean moved."""
        self.levels[0].append((n, mean, squares))
        top = 0
        for i, level in enumerate(self.levels):
            if len(level) <= MAX_BUCKETS:
                break
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._merge(level.pop(0), level.pop(0)))
            top = i + 1
        # The levels above the last one that got a bucket are as they were; that one has grown at its end.
        self._known = min(self._known, sum(len(level) for level in self.levels[top:]) - 1)
        changed = False
        while self._cut_found():
            self._drop_oldest()
            changed = True
        return changed


def score_blocks(scored: DataFrame, first_t: int, clock: int, value: str = "score") -> DataFrame:
    """Summaries of every full run of ``clock`` scored events after position ``first_t``."""
    position = F.col("t") - first_t
    rows = scored.filter(F.col("t") > first_t).select(
        "stream_id", F.ceil(position / clock).cast("long").alias("block"), F.col(value).alias("_v")
    )
    blocks = rows.groupBy("stream_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var")
    )
    full = blocks.filter(F.col("n") == clock)
    return full.select(
        "stream_id", "block", (F.col("block") * clock + first_t).alias("t"), "n", "mean",
        (F.col("_var") * F.col("n")).alias("squares"),
    )


def change_flags(blocks: DataFrame, delta: float) -> DataFrame:
    """Change flag per block. Blocks are summed before the shuffle; one stream is one sequence."""

    def make_step() -> Step:
        window = AdaptiveWindow(delta)

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in pdf.itertuples(index=False):
                changed = window.add(float(row.n), float(row.mean), float(row.squares))
                whole = window.total
                out.append((row.stream_id, row.t, changed, int(whole[0]), whole[1]))
            return pd.DataFrame(out, columns=["stream_id", "t", "adwin_detected", "window_rows", "window_mean"])

        return step

    return ordered_fold(blocks, ["stream_id"], "block", make_step, CHANGE_SCHEMA)
