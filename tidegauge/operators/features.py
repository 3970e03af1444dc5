"""Leak-free per-entity window features over strictly prior events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.config import FeatureConfig
from tidegauge.operators.ordering import with_halo, with_previous

US = 1_000_000
KEYS = ("stream_id", "entity_id")


def _sliced(events: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Entities cut into time slices with one window of look-back, so a hot entity spreads."""
    w_us = cfg.window_seconds * US
    return with_halo(events, "ts_us", w_us * cfg.chunk_windows, w_us)


def _since_last(cfg: FeatureConfig) -> Column:
    if cfg.since_last == "reference":
        return F.lit(0.0)
    gap = (F.col("ts_us") - F.col("_prev_us")) / F.lit(float(US))
    return F.when(gap.isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), gap))


def _rate(count: Column, first_us: Column) -> Column:
    span = F.greatest(F.lit(1.0), (F.col("ts_us") - first_us) / F.lit(float(US)))
    return F.when(count > 0, count / span * 60.0).otherwise(F.lit(0.0))


def _previous(events: DataFrame) -> DataFrame:
    """Time of the entity's previous event whatever the gap."""
    rows = with_previous(events, KEYS, ("ts_us", "event_id"), ["ts_us"], 86_400 * US)
    return rows.withColumn("_prev_us", F.col("_prev.ts_us")).drop("_prev")


def window_contents(events: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Each event with the array of prior events its window holds, oldest first."""
    return _contents(_sliced(events, cfg), cfg)


def _contents(sliced: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """A ROWS frame bounds the array by the event cap whatever the entity's rate; the time bound is then
    applied to the array, which is exact for ties and for a binding cap."""
    frame = (
        Window.partitionBy(*KEYS, "_chunk")
        .orderBy("ts_us", "event_id")
        .rowsBetween(-(cfg.max_events - 1), -1)
    )
    item = F.struct("ts_us", "amount", "merchant_id", "country")
    floor_us = F.col("ts_us") - F.lit(cfg.window_seconds * US)
    return (
        sliced.withColumn("_prior", F.collect_list(item).over(frame))
        .filter("_core")
        .withColumn("window", F.filter("_prior", lambda x: x["ts_us"] >= floor_us))
        .drop("_prior", "_chunk", "_core")
    )


def entity_features(events: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Window features of every event, exact in the presence of ties and of a binding cap."""
    source = _previous(events) if cfg.since_last == "lag" else events
    return _exact(_sliced(source, cfg), cfg).select(*events.columns, *cfg.enabled)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value; nulls are one value."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _sizes(first: np.ndarray, ts_us: np.ndarray, span_us: int, most: int) -> np.ndarray:
    """Number of rows before each one that its window holds; ``first`` is where the row's slice begins."""
    sizes = np.zeros(len(ts_us), np.int64)
    open_ = np.arange(len(ts_us))
    for back in range(1, most + 1):
        open_ = open_[open_ - back >= first[open_]]
        open_ = open_[ts_us[open_ - back] >= ts_us[open_] - span_us]
        if not len(open_):
            break
        sizes[open_] = back
    return sizes


def _same_before(slices: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of the last row before each one with its slice and value, -1 if none."""
    order = np.lexsort((codes, slices))
    same = (slices[order][1:] == slices[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    out = np.full(len(codes), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def window_columns(table: pa.Table, span_us: int, most: int) -> dict[str, pa.Array]:
    """Sums over the windows of rows in order of slices, time and id.

    Values are added from the oldest on, for all rows at once, one step back at a time.
    """
    keys = np.stack([_codes(table[c]) for c in (*KEYS, "_chunk")])
    new = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
    slices = np.cumsum(new)
    rows = np.arange(len(new))
    sizes = _sizes(np.flatnonzero(new)[slices - 1], table["ts_us"].to_numpy(), span_us, most)
    null = table["amount"].is_null().to_numpy()
    amount = np.where(null, 0.0, table["amount"].fill_null(0.0).to_numpy())
    gone = np.concatenate([[0], np.cumsum(null)])
    gone = gone[rows] > gone[rows - sizes]  # a sum with a null is null
    same = [_same_before(slices, _codes(table[c])) for c in ("merchant_id", "country")]

    order = np.argsort(sizes, kind="stable")
    starts, n = (rows - sizes)[order], sizes[order]
    total, squares, kinds = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros((2, len(rows)), np.int64)
    steps = [(back, int(np.searchsorted(n, back))) for back in range(int(n[-1]), 0, -1)]
    with np.errstate(invalid="ignore", over="ignore"):
        for back, a in steps:
            at = order[a:] - back
            total[a:] += amount[at]
            for kind, before in zip(kinds, same):
                kind[a:] += before[at] < starts[a:]
        mean = total / np.maximum(1, n)
        for back, a in steps:
            off = amount[order[a:] - back] - mean[a:]
            squares[a:] += off * off

    def laid(x: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        out = np.empty_like(x)
        out[order] = x
        return pa.array(out, mask=mask)

    first_us = table["ts_us"].to_numpy()[rows - sizes]
    return {
        "_n": pa.array(sizes), "_total": laid(total, gone), "_squares": laid(squares, gone), "_merchants": laid(kinds[0]),
        "_countries": laid(kinds[1]), "_first_us": pa.array(first_us),
    }


WINDOW_COLUMNS = "_n long, _total double, _squares double, _merchants long, _countries long, _first_us long"


def _windows(sliced: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """``sliced`` with its windows' sums: slices are dealt and ordered by Spark, and a task carries from batch to batch as
    many rows as a window may hold."""
    span_us, most = cfg.window_seconds * US, max(0, cfg.max_events - 1)
    kept = [c for c in sliced.columns if c not in ("_chunk", "_core")]
    needed = [*KEYS, "_chunk", "ts_us", "amount", "merchant_id", "country"]
    extra = StructType.fromDDL(WINDOW_COLUMNS)
    schema = StructType([*sliced.select(*kept).schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch.select(needed)])
            table = table.set_column(needed.index("amount"), "amount", table["amount"].cast(pa.float64()))
            carried = 0 if held is None else held.num_rows
            table = table if held is None else pa.concat_tables([held, table])
            found = window_columns(table, span_us, most)
            held = table.slice(max(0, table.num_rows - most))
            columns = [batch.column(c) for c in kept] + [x.slice(carried) for x in found.values()]
            out = pa.RecordBatch.from_arrays(columns, names=[*kept, *found])
            yield out.filter(batch.column("_core"))

    place = [*KEYS, "_chunk"]
    dealt = sliced.repartition(*place).sortWithinPartitions(*place, "ts_us", "event_id")
    return dealt.mapInArrow(run, schema)


def _exact(sliced: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The features of ``_contents`` without its arrays."""
    rows = _windows(sliced, cfg).withColumns({"cnt_5m": F.col("_n").cast("double"), "amt_sum_5m": F.col("_total")})
    some = F.col("cnt_5m") > 0
    return rows.withColumns(
        {
            "amt_mean_5m": F.when(some, F.col("amt_sum_5m") / F.col("cnt_5m")).otherwise(F.lit(0.0)),
            "amt_std_5m": F.when(some, F.sqrt(F.col("_squares") / F.col("cnt_5m"))).otherwise(F.lit(0.0)),
            "uniq_merchant_5m": F.col("_merchants").cast("double"),
            "uniq_country_5m": F.col("_countries").cast("double"),
            "time_since_last": _since_last(cfg),
            "rate_per_min": _rate(F.col("cnt_5m"), F.col("_first_us")),
        }
    )


def entity_features_range(events: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Same features from built-in aggregates over two frames, the tighter of which holds for a row.

    Prior events of the window are the last ``max_events - 1`` rows or those of the time range,
    whichever are fewer. Slices of an entity in which events share an instant, whose order a time range
    cannot see, take the exact path.
    """
    source = _previous(events) if cfg.since_last == "lag" else events
    sliced = _sliced(source, cfg)
    slices = Window.partitionBy(*KEYS, "_chunk")
    tied = sliced.withColumn("_same", (F.col("ts_us") == F.lag("ts_us").over(slices.orderBy("ts_us", "event_id"))).cast("int"))
    tied = tied.withColumn("_tied", F.coalesce(F.max("_same").over(slices), F.lit(0)) == 1).drop("_same")
    by_time = slices.orderBy("ts_us").rangeBetween(-cfg.window_seconds * US, -1)
    by_rows = slices.orderBy("ts_us", "event_id").rowsBetween(-(cfg.max_events - 1), -1)
    zero = F.lit(0.0)

    def either(column: Column) -> Column:
        return F.when(F.col("_full"), column.over(by_rows)).otherwise(column.over(by_time))

    rows = tied.withColumn("_n", F.count(F.lit(1)).over(by_time))
    rows = rows.withColumn("_full", F.col("_n") > cfg.max_events - 1)
    rows = rows.select(
        "*",
        F.least("_n", F.lit(cfg.max_events - 1)).cast("double").alias("cnt_5m"),
        F.coalesce(either(F.sum("amount")), zero).alias("amt_sum_5m"),
        F.coalesce(either(F.avg("amount")), zero).alias("amt_mean_5m"),
        F.coalesce(either(F.stddev_pop("amount")), zero).alias("amt_std_5m"),
        F.size(either(F.collect_set("merchant_id"))).cast("double").alias("uniq_merchant_5m"),
        F.size(either(F.collect_set("country"))).cast("double").alias("uniq_country_5m"),
        either(F.min("ts_us")).alias("_first_us"),
    )
    rows = rows.filter(F.col("_core") & ~F.col("_tied")).withColumns(
        {
            "time_since_last": _since_last(cfg),
            "rate_per_min": _rate(F.col("cnt_5m"), F.col("_first_us")),
        }
    )
    plain = rows.select(*events.columns, *cfg.enabled)
    return plain.unionByName(_exact(tied.filter("_tied").drop("_tied"), cfg).select(*events.columns, *cfg.enabled))
