"""Periodic runs of words: recursive splitting by frequency, then a scan of lags in what survives.

A run is a longest stretch of consecutive words that has smallest period q (words q apart are identical) and
holds at least ``REPEATS`` periods and ``SHORTEST`` words. A word inside a run therefore occurs at least
``REPEATS`` times in it. So a word that occurs less often in a segment can belong to no run there and splits the
segment; shorter pieces make further words rare, until nothing splits any more (``segments``).

The lags p of a surviving segment are scanned by marks: every p-th word. A run of period p covers four
marks in a row, which are equal, as are the stretches between them; sums of random word values compare those at
once. That takes n/p steps for lag p, n log n in all, whatever the words are. What is left is compared word by
word (``scan``), and a stretch whose period is a multiple of a smaller one is not a run of its own.

Each document is worked off by itself in one pass over the rows; nothing is shuffled.

Defined cases: null and empty texts have no words and no runs (counts 0, the chosen run's columns null, collapsed
text empty); rows that repeat are rows of their own; null keys stay null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import whole_text

REPEATS = 4
SHORTEST = 6
TEXTS_AT_ONCE = 256

Run = tuple[int, int, int]  # start, length, period

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def segments(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches (start, codes) in which every word occurs often enough to be in a run."""
    if len(codes) < SHORTEST:
        return
    at, seg = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    n_codes = int(codes.max(initial=0)) + 1
    while len(at):
        _, group, counts = np.unique(seg * n_codes + codes, return_inverse=True, return_counts=True)
        often = counts[group] >= REPEATS
        if often.all():
            break
        at, codes = at[often], codes[often]
        seg = np.cumsum(np.diff(at, prepend=at[:1]) > 1)
        if len(at):
            long = np.bincount(seg)[seg] >= SHORTEST
            at, codes, seg = at[long], codes[long], seg[long]
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        yield from zip(at[np.r_[0, cuts]].tolist(), np.split(codes, cuts))


def scan(codes: np.ndarray) -> list[Run]:
    """All runs of a segment, by lag."""
    n = len(codes)
    rng = np.random.default_rng(7)
    value = rng.integers(0, 2**63, int(codes.max(initial=0)) + 1, np.uint64)[codes]
    power = np.full(n + 1, rng.integers(2**40, 2**62, dtype=np.uint64) | np.uint64(1))
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n])])
    reach, step = np.zeros(n, np.int64), np.ones(n, np.int64)  # end and period of a run known at a word
    found: dict[tuple[int, int], Run] = {}
    for p in range(1, n // REPEATS + 1):
        marks = codes[::p]
        same = marks[:-1] == marks[1:]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(k):
            continue
        a = k * p
        k = k[(total[a + 2 * p] - total[a]) * power[p] == total[a + 3 * p] - total[a + p]]
        if not len(k):
            continue
        a = k * p
        known = (reach[a] > a + 3 * p) & (p % step[a] == 0)
        cuts = np.flatnonzero(np.diff(k) > 1) + 1
        for some, old in zip(np.split(k, cuts), np.split(known, cuts)):
            if old.all():
                continue
            low, high = max(0, (int(some[0]) - 1) * p + 1), min(n, (int(some[-1]) + 4) * p)
            differ = np.flatnonzero(codes[low : high - p] != codes[low + p : high])
            begins, ends = np.r_[0, differ + 1], np.r_[differ, high - p - low]
            for b, e in zip(begins.tolist(), ends.tolist()):
                length = e - b + p
                if length < max(SHORTEST, REPEATS * p) or (low + b, length) in found:
                    continue
                found[low + b, length] = (low + b, length, p)
                reach[low + b : low + b + length] = low + b + length
                step[low + b : low + b + length] = p
    return list(found.values())


def runs_of(words: Sequence) -> list[Run]:
    """All runs by start, then period."""
    numbers: dict = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = [(start + s, length, p) for start, some in segments(codes) for s, length, p in scan(some)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run of most periods; of equal ones the first, then that of the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """Words joined by blanks, without those that a run repeats."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, runs by start and period, start, length and period of the strongest, collapsed text."""
    key_type = df.schema[key].dataType
    arrow = pa.schema(
        [
            ("key", pa.int64()),
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
            *[(c, pa.int64()) for c in ("start", "length", "period")],
            ("collapsed", pa.string()),
        ]
    )
    schema = T.StructType.fromDDL(f"key bigint, n_words bigint, runs {RUN}, start bigint, length bigint, period bigint, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                rows = []
                for k, data in zip(some.column("key").to_pylist(), some.column("text").cast(pa.binary()).to_pylist()):
                    words = data.split()  # bytes split at the ASCII white space of the contract
                    runs = runs_of(words)
                    best = strongest(runs) or (None, None, None)
                    listed = [dict(zip(("start", "length", "period"), r)) for r in runs]
                    rows.append((k, len(words), listed, *best, collapsed(words, runs).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    rows = df.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)
