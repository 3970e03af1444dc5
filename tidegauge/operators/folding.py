"""Ordered folds over per-stream summary tables, in bounded memory.

``ordered_fold`` follows one stream after the other. ``chunked_fold`` cuts a stream into chunks that run in
parallel from predicted start states and repeats those whose prediction was wrong; what does not agree in a
few rounds is followed in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, ClassVar, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import hinted, stage

#: Rounds of chunks in parallel; what they leave open is followed in order.
ROUNDS = 4

# A fold is built per stream and fed batches of rows in order; it returns output rows.
Step = Callable[[pd.DataFrame], pd.DataFrame]


class Fold(Protocol):
    """A fold whose state can be written down: column types, values, and back."""

    FIELDS: ClassVar[dict[str, str]]

    def dump(self) -> dict[str, Any]: ...

    def load(self, state: dict[str, Any]) -> None: ...

    def step(self, pdf: pd.DataFrame) -> pd.DataFrame: ...


def in_order(values: pd.Series, last: Any, key: Any) -> Any:
    """The last of ``values``, which must rise and follow ``last``."""
    if not values.is_monotonic_increasing or (last is not None and values.iloc[0] < last):
        raise RuntimeError(f"rows of {key} arrived out of order")
    return values.iloc[-1]


def ordered_fold(df: DataFrame, by: list[str], order: str, make_step: Callable[[], Step], schema: str) -> DataFrame:
    """Fold each group in ``order``, batch by batch.

    Streams are spread over tasks; rows of one stream reach its fold as a sequence of Arrow
    batches, so memory does not grow with the stream. Feed it summaries (ticks, evaluations,
    blocks), not events.
    """
    arranged = df.repartition(*by).sortWithinPartitions(*by, order)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make_step()
        last = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            last = in_order(pdf[order], last, key)
            yield step(pdf)

    return arranged.groupBy(*by).applyInPandas(run, schema)


def _blank(kind: str) -> Column:
    """A value that keeps a column free of nulls, which would change its type in pandas."""
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit("" if kind == "string" else 0).cast(kind)


def chunked_fold(
    df: DataFrame, by: list[str], order: str, width: int, make_fold: Callable[[], Fold], schema: str, name: str = "fold"
) -> DataFrame:
    """The fold of each group in ``order``, computed by chunks of ``width`` positions in parallel.

    In the first round every chunk starts from the state of a new fold, in later ones from the state its
    predecessor ended with in the round before; only chunks whose start has changed run again. When no
    start changes, every chunk has started where its predecessor ends, from the group's first chunk on,
    which is the sequential result. Folds that forget (thresholds that reach their target, histories of bounded
    length) agree after two or three rounds. Where chunks are shorter than what the fold remembers, every round
    settles but one more chunk: after ``ROUNDS`` rounds the rows from a group's first open chunk on are followed
    in order, batch by batch, from the state that its settled chunks end with. The driver sees one count a round.
    """
    fields = make_fold().FIELDS
    out_names = [c.split()[0] for c in schema.split(", ")]
    states = [f"_state_{f}" for f in fields]
    full = f"_chunk long, {schema}, _end boolean, " + ", ".join(f"{s} {t}" for s, t in zip(states, fields.values()))
    rows = stage(df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("long")), f"{name}-rows")
    place = [*by, "_chunk"]
    numbered = rows.select(*place).distinct()
    before = F.lag("_chunk").over(Window.partitionBy(*by).orderBy("_chunk"))
    chunks = stage(numbered.withColumn("_before", before), f"{name}-chunks")

    def run(key: tuple[Any, ...], pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        fold = make_fold()
        if len(start) and bool(start["_known"].iloc[0]):
            fold.load({f: start[s].iloc[0] for f, s in zip(fields, states)})
        pdf = pdf.sort_values(order)
        out = fold.step(pdf)[out_names].reset_index(drop=True)
        out["_chunk"] = key[-1]
        out["_end"] = [False] * (len(out) - 1) + [True]
        state = fold.dump()
        for f, s in zip(fields, states):
            out[s] = pd.Series([None] * (len(out) - 1) + [state[f]], dtype=object)
        return out[["_chunk", *out_names, "_end", *states]]

    def marked(table: DataFrame) -> DataFrame:
        return table.withColumn("_mark", F.md5(F.to_json(F.struct(*states), {"ignoreNullFields": "false"})))

    starts = chunks.select(*place, F.lit(False).alias("_known"), *[F.lit(None).cast(t).alias(s) for s, t in zip(states, fields.values())])
    used = chunks.select(*place, F.lit("").alias("_used"))  # mark of the state each chunk last started from
    latest: DataFrame | None = None  # newest round of each chunk
    opening: DataFrame | None = None  # first open chunk of each group after the last round, and its start
    rounds: list[DataFrame] = []
    while True:
        todo = starts.select(*place)
        work = rows.join(hinted(todo), place, "left_semi") if rounds else rows
        made = stage(work.groupBy(*place).cogroup(starts.groupBy(*place)).applyInPandas(run, full), f"{name}-round")
        number = F.lit(len(rounds)).alias("_round")
        rounds.append(made)
        mine = todo.select(*place, number)
        latest = mine if latest is None else stage(latest.unionByName(mine).groupBy(*place).agg(F.max("_round").alias("_round")), f"{name}-latest")
        ends = reduce(DataFrame.unionByName, [r.filter("_end").select(*place, *states).withColumn("_round", F.lit(i)) for i, r in enumerate(rounds)])
        ends = marked(ends.join(latest, [*place, "_round"], "left_semi").drop("_round"))
        after = ends.withColumnRenamed("_chunk", "_before").join(chunks.filter("_before IS NOT NULL"), [*by, "_before"])
        changed = after.join(used, place).filter(F.col("_mark") != F.col("_used"))
        starts = stage(changed.select(*place, F.lit(True).alias("_known"), *states, "_mark"), f"{name}-starts")
        if starts.isEmpty():
            break
        if len(rounds) == ROUNDS:
            first = starts.groupBy(*by).agg(F.min("_chunk").alias("_chunk"))
            opening = starts.join(first, place, "left_semi").select(*place, *states)
            break
        fresh = starts.select(*place, F.col("_mark").alias("_new"))
        used = stage(used.join(fresh, place, "left").select(*place, F.coalesce("_new", "_used").alias("_used")), f"{name}-used")
        starts = starts.drop("_mark")
    whole = reduce(DataFrame.unionByName, [r.withColumn("_round", F.lit(i)) for i, r in enumerate(rounds)])
    whole = whole.join(latest, [*place, "_round"], "left_semi")
    if opening is None:
        return whole.select(*out_names)
    since = hinted(opening.select(*by, F.col("_chunk").alias("_open")))
    settled = whole.join(since, by, "left").filter("_open IS NULL OR _chunk < _open").select(*out_names)
    rest = rows.join(since, by).filter("_chunk >= _open").drop("_chunk", "_open")
    columns = rest.columns
    begun = opening.select(*by, *[_blank(f.dataType.simpleString()).alias(f.name) for f in rest.schema if f.name not in by], F.lit(False).alias("_row"), *states)
    going = rest.select("*", F.lit(True).alias("_row"), *[_blank(t).alias(s) for s, t in zip(states, fields.values())])
    # A group's start comes before its rows.
    arranged = begun.unionByName(going).repartition(*by).sortWithinPartitions(*by, "_row", order)

    def follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, last = make_fold(), None
        for pdf in batches:
            if len(pdf) and not pdf["_row"].iloc[0]:
                fold.load({f: pdf[s].iloc[0] for f, s in zip(fields, states)})
                pdf = pdf.iloc[1:]
            if len(pdf) == 0:
                continue
            pdf = pdf[columns]
            last = in_order(pdf[order], last, key)
            yield fold.step(pdf)[out_names]

    return settled.unionByName(stage(arranged.groupBy(*by).applyInPandas(follow, schema), f"{name}-rest"))
