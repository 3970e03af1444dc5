"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document's ids (with the end id) fill whole windows first. What is left over goes, online, to the fill
level that makes the sum of squared counts of partially filled windows least: a level array counts the open
windows of each fill, and opening a new window is one of the choices. Each task packs the rows it reads, so
nothing is shuffled and a task that is run again packs the same way.

When a task ends, or ``MAX_OPEN`` windows are open (which bounds its memory), the pieces of the open windows
are laid end to end and cut at window size; the very last stretch is cut at powers of two, which need no
padding. So padding is not the price of bounded memory.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each on their own; null
keys stay null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import whole_text
from tidegauge.llm.tokens import LEADING_SPACE, encoder
from tidegauge.operators.ordering import event_index

WINDOW = 1024
MAX_OPEN = 4096
TEXTS_AT_ONCE = 256
#: Sequence ids are task << TASK_SHIFT | number in the task.
TASK_SHIFT = 40

Piece = tuple  # ((key, place), start, ids, doc_tokens)


class SumOfSquares:
    """Level array of the open windows; ``place`` gives pieces of windows that are full."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level(self, size: int) -> int:
        """Fill level to place ``size`` ids on; 0 opens a window. Of equal choices the fullest."""
        top = self.window - size
        here, there = self.count[1 : top + 1], self.count[1 + size : top + size + 1]
        change = 2 * there - 2 * here + 2
        if top:
            change[-1] = 1 - 2 * here[-1]  # a window that gets full is no longer counted
        change[here == 0] = np.iinfo(np.int64).max
        new = 2 * int(self.count[size]) + 1 if size < self.window else 0
        if not top or change.min() > new:
            return 0
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2])
        at = self.level(size)
        if at:
            held = self.open[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if at + size == self.window:
            yield held
            return
        self.open.setdefault(at + size, []).append(held)
        self.count[at + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            yield from self.close()

    def close(self) -> Iterator[list[Piece]]:
        """Windows cut anew from all open ones, then powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for held in self.open[level] for p in held]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        left = sum(len(p[2]) for p in pieces)
        limit = self.window
        held: list[Piece] = []
        room = limit if left >= limit else 1 << max(0, left.bit_length() - 1)
        for key, start, ids, total in pieces:
            while len(ids):
                some = ids[:room]
                held.append((key, start, some, total))
                ids, start = ids[len(some) :], start + len(some)
                room -= len(some)
                left -= len(some)
                if not room:
                    yield held
                    held = []
                    room = limit if left >= limit else 1 << max(0, left.bit_length() - 1)
        if held:
            raise AssertionError("pieces left over")


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, window: int = WINDOW, max_open: int = MAX_OPEN, place: Column | None = None
) -> DataFrame:
    """Pieces: key, start, length, doc_tokens, sequence_id, offset, place, and ids as little-endian 32-bit binary.

    ``window`` must be a power of two. Ids of a document lie in exactly one piece each; offsets in a sequence
    have no gaps. ``place`` is a number of the document that its pieces keep, such as its place in the training order
    (null if not given); ``in_order`` numbers sequences by it.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    key_type = df.schema[key].dataType
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset", "place")
    schema = T.StructType([T.StructField("key", T.LongType())] + [T.StructField(c, T.LongType()) for c in longs] + [T.StructField("ids", T.BinaryType())])
    arrow = pa.schema([("key", pa.int64()), *[(c, pa.int64()) for c in longs], ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, LEADING_SPACE)
        end = np.array([end_id], "<u4")
        levels = SumOfSquares(window, max_open)
        sequence = TaskContext.get().partitionId() << TASK_SHIFT
        rows: list[tuple] = []

        def emit(held: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for (k, place), start, ids, total in held:
                rows.append((k, start, len(ids), total, sequence, at, place, ids.tobytes()))
                at += len(ids)
            sequence += 1

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
            rows.clear()
            return made

        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(a, TEXTS_AT_ONCE)
                keys = zip(some.column("key").to_pylist(), some.column("place").to_pylist())
                for k, ids in zip(keys, encode.ids(some.column("text").to_pylist())):
                    ids = np.concatenate([ids, end])
                    total, whole = len(ids), len(ids) // window * window
                    for start in range(0, whole, window):
                        emit([(k, start, ids[start : start + window], total)])
                    if whole < total:
                        for held in levels.place((k, whole, ids[whole:].copy(), total)):
                            emit(held)
                if len(rows) >= 500:
                    yield table()
        for held in levels.close():
            emit(held)
        if rows:
            yield table()

    at = F.lit(None) if place is None else place
    pieces = df.select(F.col(key).cast("long").alias("key"), at.cast("long").alias("place"), whole_text(text).alias("text")).mapInArrow(run, schema)
    return pieces.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces with sequences numbered from 0 by the smallest place of their documents."""
    sequences = pieces.groupBy("sequence_id").agg(F.min("place").alias("_first"))
    numbered = event_index(sequences, by=(), order=("_first", "sequence_id"), name="_number").select("sequence_id", "_number")
    named = pieces.join(numbered, "sequence_id").withColumn("sequence_id", F.col("_number") - 1)
    return named.select(*pieces.columns)
