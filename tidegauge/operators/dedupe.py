"""Idempotency on tables: first occurrence of an id wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import first_rows
from tidegauge.session import stage


def first_per_id(df: DataFrame, id_col: str = "event_id", order: Sequence[str] = ("ts_us",)) -> DataFrame:
    """Earliest row of each id. An aggregate, not a window: copies collapse before the shuffle,
    so an id that makes up much of the table does not land in one task."""
    rest = [c for c in df.columns if c != id_col]
    # Rows of one instant are told apart by a hash, so the choice is repeatable.
    hashable = [name for name, kind in df.dtypes if "map<" not in kind]
    first = F.min_by(F.struct(*rest), F.struct(*order, F.xxhash64(*hashable)))
    picked = df.groupBy(id_col).agg(first.alias("_row"))
    return picked.select(*[F.col(id_col) if c == id_col else F.col(f"_row.{c}") for c in df.columns])


def duplicate_counts(df: DataFrame, by: Sequence[str], id_col: str = "event_id") -> DataFrame:
    """Surplus occurrences per source: an id seen n times counts n - 1."""
    per_id = df.groupBy(*by, id_col).agg(F.count(F.lit(1)).alias("_n"))
    return per_id.groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def opening_events(events: DataFrame, n: int, dedupe: bool = True) -> DataFrame:
    """First ``n`` distinct events of every stream with their position ``idx``.

    Reads a bounded prefix of each stream and lengthens it only if copies left it short.
    """
    order = ("ts_us", "event_id")
    if not dedupe:
        return first_rows(events, ["stream_id"], order, n)
    length = 2 * n
    while True:
        prefix = stage(first_rows(events, ["stream_id"], order, length), "opening")
        read = prefix.groupBy("stream_id").agg(F.count(F.lit(1)).alias("r"), F.count_distinct("event_id").alias("d"))
        if read.filter((F.col("r") == length) & (F.col("d") < n)).isEmpty():
            return first_rows(first_per_id(prefix.drop("idx")), ["stream_id"], order, n)
        length *= 2
