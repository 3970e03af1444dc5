"""Entity windows as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegauge.config import FeatureConfig
from tidegauge.operators.features import KEYS, US, window_columns

#: Groups that entities are dealt into: a call works on all new rows of a group at once.
GROUPS = 1024
FIELDS = ("ts_us", "event_id", "amount", "merchant_id", "country")
ENTITY = "stream_id string, entity_id string"
#: An entity's window as one value, column by column: read and written in one message each.
WINDOW = "ts_us array<bigint>, event_id array<string>, amount array<double>, merchant_id array<string>, country array<string>"
ROWS = pa.schema(
    [("stream_id", pa.string()), ("entity_id", pa.string()), ("ts_us", pa.int64()), ("event_id", pa.string()),
     ("amount", pa.float64()), ("merchant_id", pa.string()), ("country", pa.string())]
)


def features_of(rows: pa.Table, first: np.ndarray, cfg: FeatureConfig) -> dict[str, np.ndarray]:
    """Window features of rows in order of entities, time and id; ``first`` marks where an entity begins."""
    whole = rows.append_column("_chunk", pa.array(np.zeros(rows.num_rows, np.int64)))
    found = window_columns(whole, cfg.window_seconds * US, max(0, cfg.max_events - 1))
    found = {n: x.to_numpy(zero_copy_only=False) for n, x in found.items()}
    ts = rows["ts_us"].to_numpy()
    count = found["_n"].astype(float)
    some, n = count > 0, np.maximum(1.0, count)
    gap = np.zeros(len(ts))
    if cfg.since_last == "lag":
        gap = np.where(first, np.inf, np.maximum(0.0, np.diff(ts, prepend=ts[0]) / US))
    return {
        "cnt_5m": count,
        "amt_sum_5m": found["_total"],
        "amt_mean_5m": found["_total"] / n,
        "amt_std_5m": np.sqrt(found["_squares"] / n),
        "uniq_merchant_5m": found["_merchants"].astype(float),
        "uniq_country_5m": found["_countries"].astype(float),
        "time_since_last": gap,
        "rate_per_min": np.where(some, count / np.maximum(1.0, (ts - found["_first_us"]) / US) * 60.0, 0.0),
    }


class EntityWindows(StatefulProcessor):
    """Keeps each entity's last events, bounded by cap and window, and features the new ones."""

    def __init__(self, cfg: FeatureConfig, columns: list[str]) -> None:
        self.cfg, self.columns = cfg, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", ENTITY, WINDOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        arrived = pa.table([pa.array(new[c], f.type, from_pandas=True) for c, f in zip(ROWS.names, ROWS)], ROWS)
        entities = list(zip(*arrived.select(KEYS).group_by(list(KEYS)).aggregate([]).to_pydict().values(), strict=True))
        held = [(e, w) for e, w in ((e, self.windows.getValue(e)) for e in entities) if w is not None]
        kept = {k: [e[i] for e, w in held for _ in w[0]] for i, k in enumerate(KEYS)}
        kept |= {f: list(chain.from_iterable(w[i] for _, w in held)) for i, f in enumerate(FIELDS)}
        whole = pa.concat_tables([pa.table(kept, ROWS), arrived])
        # Rows of a late batch take their place among the kept ones; of equal rows the kept ones come first.
        order = pc.sort_indices(whole, [(c, "ascending") for c in (*KEYS, "ts_us", "event_id")]).to_numpy().astype(np.int64)
        whole, place = whole.take(order), order - (whole.num_rows - len(new))
        first = np.r_[True, np.logical_or.reduce([self._changes(whole[k]) for k in KEYS])]
        features = features_of(whole, first, self.cfg)
        self._keep(whole, np.flatnonzero(first))
        at = np.flatnonzero(place >= 0)
        yield pd.DataFrame({c: new[c].to_numpy()[place[at]] for c in self.columns} | {n: features[n][at] for n in self.cfg.enabled})

    @staticmethod
    def _changes(column: pa.ChunkedArray) -> np.ndarray:
        codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return codes[1:] != codes[:-1]

    def _keep(self, whole: pa.Table, starts: np.ndarray) -> None:
        """The end of each entity's rows, which begin at ``starts``, becomes its window."""
        ts = whole["ts_us"].to_numpy()
        ends = np.r_[starts[1:], len(ts)]
        after = np.repeat(ends, ends - starts)
        keep = (ts >= ts[after - 1] - self.cfg.window_seconds * US) & (np.arange(len(ts)) >= after - self.cfg.max_events)
        sizes = np.add.reduceat(keep.astype(np.int64), starts)
        rows = whole.filter(pa.array(keep)).to_pydict()
        bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            self.windows.updateValue(tuple(rows[k][a] for k in KEYS), tuple(rows[f][a:b] for f in FIELDS))

    def close(self) -> None:
        pass


def stream_features(events: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Window features of a stream; state is kept per entity in the state store."""
    columns = [c for c in events.columns if c != "event_time"]
    schema = T.StructType(
        [f for f in events.schema.fields if f.name in columns] + [T.StructField(n, T.DoubleType()) for n in cfg.enabled]
    )
    dealt = events.withColumn("_group", F.pmod(F.xxhash64(*KEYS), F.lit(GROUPS)))
    return dealt.groupBy("_group").transformWithStateInPandas(
        EntityWindows(cfg, columns), outputStructType=schema, outputMode="Append", timeMode="None"
    )
