"""Streaming drift monitor: micro-batches become summaries, summaries drive small keyed state.

Three queries, each with its own checkpoint. ``Indexer`` runs per micro-batch of scored rows: it numbers them,
stores them, and writes the summaries that became due (change-detection blocks, evaluations, controller ticks),
computed by the batch operators over the new rows and a bounded tail. ``decisions`` advances the drift and threshold
state of each stream over those summaries only. ``Judge`` runs per micro-batch of decisions and appends the alerts of the
rows they settle.

Every table has a folder per batch, which a replay of the batch overwrites. A batch reads its own rows and what its
predecessor left (last positions, a tail of one window, profile versions in force, last thresholds), never history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import merge
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegauge.config import EngineConfig
from tidegauge.operators import adwin, control, drift, profile
from tidegauge.operators.alerts import alerts_of
from tidegauge.operators.ordering import event_index
from tidegauge.session import small

#: Kinds of summaries, in the order in which those of one event count. A mark ends the rows of a batch.
BLOCK, EVALUATION, TICK, MARK = range(4)
_ARRAY, _TEXT = "array<double>", "string"
SUMMARY = {
    "stream_id": _TEXT, "t": "long", "kind": "int", "u": "long", "profile_id": "int", "psi": _ARRAY, "ks": _ARRAY,
    "ks_critical": _ARRAY, "mean_shift_z": _ARRAY, "score_psi": "double", "score_ks": "double",
    "score_ks_critical": "double", "n": "long", "mean": "double", "squares": "double", "ts_us": "long",
    "event_id": _TEXT, "n_history": "long", "proposal": "double", "over_mark": "double", "under_mark": "double",
    "frozen": "boolean",
}
DECISION = {
    "stream_id": _TEXT, "t": "long", "kind": "int", "batch_id": "int", "drift_score": "double", "drift_threshold": "double",
    "vote_ratio": "double", "drift_warning_active": "boolean", "drift_active": "boolean",
    "adwin_detected": "boolean", "profile_id": "int", "threshold": "double", "changed": "boolean",
}
ENDS = "stream_id string, last_t long, last_us long, action_us long, action string"


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


class BatchTables:
    """Tables below ``base`` with a folder per batch."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def path(self, table: str, batch_id: int) -> str:
        return f"{self.base}/{table}/batch_id={batch_id}"

    def write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table, batch_id))
        return self.spark.read.schema(df.schema).parquet(self.path(table, batch_id))

    def read(self, table: str, batch_id: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table, batch_id))

    def drop(self, table: str, batch_id: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table, batch_id))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Indexer:
    """``foreachBatch`` function; every write replaces its own batch, so replays are harmless.

    ``base``: folder of the tables. ``reference``: frozen profile, version 0. Positions go on from those of the
    earlier batch; rows of one batch are numbered in event order. ``controls``: table of operator actions, of which a
    batch takes those between the last event before it and its own last event. A refresh makes the current window the
    reference from then on, as in a batch run.
    """

    CARRIED = ("ends", "tail", "versions")

    def __init__(self, base: str, cfg: EngineConfig, reference: DataFrame, controls: DataFrame | None = None) -> None:
        self.base, self.cfg, self.reference, self.controls = base, cfg, reference, controls

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, cfg = batch.sparkSession, self.cfg
        tables = BatchTables(spark, self.base)
        before = tables.read("ends", batch_id - 1, ENDS) if batch_id else spark.createDataFrame([], ENDS)
        known = small(before.select("stream_id", F.col("last_t").alias("_o")))
        rows = event_index(batch, name="_n").join(known, "stream_id", "left")
        rows = rows.withColumn("t", F.col("_n") + F.coalesce("_o", F.lit(0))).drop("_n", "_o")
        fresh = tables.write(rows, "scored", batch_id)
        ends = tables.write(self._ends(before, fresh), "ends", batch_id)
        first = small(fresh.groupBy("stream_id").agg(F.min("t").alias("first_t")))
        recent = fresh
        if batch_id:
            recent = tables.read("tail", batch_id - 1, fresh.schema).unionByName(fresh)
        look_back = max(cfg.drift.window_size, cfg.control.history) + cfg.drift.adwin_clock
        tail = recent.join(small(ends.select("stream_id", "last_t")), "stream_id").filter(F.col("t") > F.col("last_t") - look_back)
        tables.write(tail.select(*fresh.columns), "tail", batch_id)
        held = tables.read("versions", batch_id - 1, self.reference.schema) if batch_id else self.reference
        versions = tables.write(self._versions(recent, held, before, ends), "all_versions", batch_id)
        in_force = versions.filter("to_u IS NULL")
        tables.write(in_force, "versions", batch_id)
        tables.write(self._summaries(recent, versions, first, before, ends), "summaries", batch_id)
        for table in self.CARRIED:
            if batch_id > 1:
                tables.drop(table, batch_id - 2)

    def _between(self, actions: Sequence[str], before: DataFrame, ends: DataFrame, last: bool) -> DataFrame:
        """Actions after the last event before the batch, up to its last event (inclusive if ``last``)."""
        span = ends.select("stream_id", "last_us").join(before.select("stream_id", F.col("last_us").alias("_from")), "stream_id", "left")
        rows = self.controls.filter(F.col("action").isin(*actions)).join(small(span), "stream_id")
        start = F.coalesce("_from", F.lit(-(2**62)))
        if last:
            within = (F.col("ts_us") > start) & (F.col("ts_us") <= F.col("last_us"))
        else:
            within = (F.col("ts_us") >= start) & (F.col("ts_us") < F.col("last_us"))
        return rows.filter(within).select("stream_id", "ts_us", "action")

    def _ends(self, before: DataFrame, fresh: DataFrame) -> DataFrame:
        now = fresh.groupBy("stream_id").agg(F.max("t").alias("last_t"), F.max("ts_us").alias("last_us"))
        moved = now.select("*", F.lit(None).cast("long").alias("action_us"), F.lit(None).cast("string").alias("action"))
        ends = before.unionByName(moved)
        if self.controls is not None:
            reached = before.unionByName(moved).groupBy("stream_id").agg(F.max("last_us").alias("last_us"))
            acts = self._between((control.FREEZE, control.UNFREEZE), before, reached, last=True)
            none = [F.lit(None).cast("long").alias(c) for c in ("last_t", "last_us")]
            ends = ends.unionByName(acts.select("stream_id", *none, F.col("ts_us").alias("action_us"), "action"))
        act = F.max(F.when(F.col("action_us").isNotNull(), F.struct("action_us", "action")))
        whole = ends.groupBy("stream_id").agg(F.max("last_t").alias("last_t"), F.max("last_us").alias("last_us"), act.alias("_act"))
        return whole.select("stream_id", "last_t", "last_us", "_act.action_us", "_act.action").filter("last_t IS NOT NULL")

    def _versions(self, recent: DataFrame, held: DataFrame, before: DataFrame, ends: DataFrame) -> DataFrame:
        if self.controls is None:
            return held
        asked = self._between((control.REFRESH,), before, ends, last=False)
        return profile.refreshed_profiles(recent, held, asked, self.cfg.drift, self.cfg.features.enabled).select(*held.columns)

    def _with_controls(self, ticks: DataFrame, before: DataFrame, ends: DataFrame) -> DataFrame:
        if self.controls is None:
            return ticks.withColumn("frozen", F.lit(False))
        acts = self._between((control.FREEZE, control.UNFREEZE), before, ends, last=True)
        carried = before.filter("action IS NOT NULL").select("stream_id", F.col("action_us").alias("ts_us"), "action")
        return control.latest_action(ticks, carried.unionByName(acts))

    def _summaries(self, rows: DataFrame, versions: DataFrame, first: DataFrame, before: DataFrame, ends: DataFrame) -> DataFrame:
        d, c, names = self.cfg.drift, self.cfg.control, self.cfg.features.enabled

        def due(part: DataFrame) -> DataFrame:
            """A tail cut inside a window must not produce summaries of old rows."""
            return part.join(first, "stream_id").filter(F.col("t") >= F.col("first_t"))

        panes = profile.pane_stats(rows, versions, d, names)
        evaluations = drift.evaluation_rows(profile.windowed_distances(panes, versions, d), names)
        ticks = self._with_controls(due(control.tick_quantiles(rows, c)), before, ends)
        out = [due(evaluations).withColumn("kind", F.lit(EVALUATION)), ticks.withColumn("kind", F.lit(TICK))]
        reached = ends.join(first.select("stream_id"), "stream_id", "left_semi")
        out.append(reached.select("stream_id", F.col("last_t").alias("t"), F.lit(MARK).alias("kind")))
        if d.adwin_enabled:
            blocks = adwin.score_blocks(rows, d.reference_events, d.adwin_clock)
            out.append(due(blocks).withColumn("kind", F.lit(BLOCK)))
        aligned = [
            part.select(*[(F.col(n) if n in part.columns else F.lit(None)).cast(k).alias(n) for n, k in SUMMARY.items()])
            for part in out
        ]
        whole = aligned[0]
        for part in aligned[1:]:
            whole = whole.unionByName(part)
        return whole


#: Columns that the summaries of a kind fill, and flags that are set where they are decided.
_ALL = ["stream_id", "t", "kind", "batch_id"]
_COLUMNS = {
    BLOCK: [*_ALL, "n", "mean", "squares"],
    EVALUATION: [*_ALL, "u", "profile_id", "psi", "ks", "ks_critical", "mean_shift_z", "score_psi", "score_ks", "score_ks_critical"],
    TICK: [*_ALL, "ts_us", "event_id", "n_history", "proposal", "over_mark", "under_mark", "frozen"],
    MARK: _ALL,
}
_FLAGS = {EVALUATION: "adwin_detected", TICK: "drift_active"}
#: Decisions that leave a stream's task at once.
DECISION_ROWS = 20_000


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[Any]:
    """Summaries of a stream by position and kind. Each kind is held with its own columns only and put in order by
    itself; the kinds are merged as they are read."""
    parts: dict[int, list[pd.DataFrame]] = {kind: [] for kind in _COLUMNS}
    for pdf in batches:
        for kind, columns in _COLUMNS.items():
            parts[kind].append(pdf.loc[pdf["kind"] == kind, columns])
    runs = []
    for kind, held in parts.items():
        table = pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=_COLUMNS[kind])
        held.clear()
        table = table.sort_values("t", kind="stable", ignore_index=True)
        runs.append((table.assign(**{_FLAGS[kind]: False}) if kind in _FLAGS else table).itertuples(index=False))
    return merge(*runs, key=lambda row: (row.t, row.kind))


class Decisions(StatefulProcessor):
    """Drift and threshold state of one stream, advanced by its summaries in order.

    State is three rows of typed columns (``drift``, ``threshold``, ``window``) that Spark's state reader shows as a
    table. A new stream may start from rows of that form.
    """

    def __init__(self, cfg: EngineConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = {name: handle.getValueState(name, _ddl(fields)) for name, fields in STATES.items()}

    def _folds(self) -> dict:
        return {"drift": drift.DriftFold(self.cfg.drift), "threshold": control.ThresholdFold(self.cfg.control), "window": adwin.AdaptiveWindow(self.cfg.drift.adwin_delta)}

    def _load(self) -> tuple[dict, int, bool]:
        folds, flag_t, active = self._folds(), -1, False
        for name, fold in folds.items():
            if self.values[name].exists():
                state = dict(zip(STATES[name], self.values[name].get(), strict=True))
                fold.load(state)
                if name == "drift":
                    flag_t, active = int(state["flag_t"]), bool(state["flag_active"])
        return folds, flag_t, active

    def _store(self, folds: dict, flag_t: int, active: bool) -> None:
        for name, fold in folds.items():
            state = fold.dump() | ({"flag_t": int(flag_t), "flag_active": bool(active)} if name == "drift" else {})
            self.values[name].update(tuple(state[f] for f in STATES[name]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg = self.cfg
        folds, flag_t, flag_active = self._load()
        changed_at = -1
        out = []
        for row in _ordered(rows):
            decision = dict.fromkeys(DECISION) | {"stream_id": row.stream_id, "t": row.t, "kind": row.kind, "batch_id": row.batch_id}
            if row.kind == BLOCK:
                if folds["window"].add(float(row.n), float(row.mean), float(row.squares)):
                    changed_at = row.t
                continue
            if row.kind == EVALUATION:
                state = folds["drift"].advance(row._replace(adwin_detected=changed_at == row.t))
                flag_t, flag_active = row.t, state["drift_active"]
                decision |= {n: state[n] for n in DECISION if n in state}
            elif row.kind == TICK:
                active = flag_active and (cfg.drift.mode == "latched" or flag_t == row.t)
                done = dict(zip(control.CONTROL_COLUMNS, folds["threshold"].advance(row._replace(drift_active=active)), strict=True))
                decision |= {"threshold": done["threshold"], "changed": done["changed"]}
            out.append(decision)
            if len(out) == DECISION_ROWS:
                yield pd.DataFrame(out, columns=list(DECISION))
                out = []
        self._store(folds, flag_t, flag_active)
        yield pd.DataFrame(out, columns=list(DECISION))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start of a stream from a row of ``initial_states``."""
        row = initialState.iloc[0]
        for name, fields in STATES.items():
            if row[f"{name}_{next(iter(fields))}"] is not None:
                self.values[name].update(tuple(_plain(row[f"{name}_{f}"]) for f in fields))

    def close(self) -> None:
        pass


#: Columns of the state rows.
STATES = {
    "drift": drift.DriftFold.FIELDS | {"flag_t": "long", "flag_active": "boolean"},
    "threshold": control.ThresholdFold.FIELDS,
    "window": adwin.AdaptiveWindow.FIELDS,
}


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


def index_stream(
    scored: DataFrame, base: str, cfg: EngineConfig, reference: DataFrame, controls: DataFrame | None = None
) -> StreamingQuery:
    """First query: number and store scored rows, write due summaries."""
    writer = scored.writeStream.foreachBatch(Indexer(base, cfg, reference, controls)).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{base}/checkpoints/index").start()


def decision_stream(spark: SparkSession, base: str, cfg: EngineConfig, initial: DataFrame | None = None) -> DataFrame:
    """Second query: evaluations and thresholds from the summaries. ``initial``: states that streams start from (as
    ``state_table`` gives them); they count for streams the checkpoint does not know."""
    summaries = spark.readStream.schema(_ddl(SUMMARY | {"batch_id": "int"})).parquet(f"{base}/summaries")
    start = None if initial is None else initial.groupBy("stream_id")
    return summaries.groupBy("stream_id").transformWithStateInPandas(
        Decisions(cfg), outputStructType=_ddl(DECISION), outputMode="Append", timeMode="None", initialState=start
    )


def state_table(spark: SparkSession, base: str) -> DataFrame:
    """Drift, threshold and change-detection state of every stream, read from the checkpoint: one row per stream
    with the columns of ``STATES``, prefixed by their state."""
    whole: DataFrame | None = None
    for name, fields in STATES.items():
        raw = spark.read.format("statestore").option("stateVarName", name).load(f"{base}/checkpoints/decide")
        part = raw.select(F.col("key.stream_id").alias("stream_id"), *[F.col(f"value.{f}").alias(f"{name}_{f}") for f in fields])
        whole = part if whole is None else whole.join(part, "stream_id", "full")
    return whole


class Judge:
    """``foreachBatch`` function over decisions: rows whose thresholds they settle become alerts.

    The summaries of a stored batch are decided together, so its rows are judged once: each meets its tick among the new
    ones, or the last one before them.
    """

    def __init__(self, base: str, cfg: EngineConfig) -> None:
        self.base, self.cfg = base, cfg

    def __call__(self, decided: DataFrame, batch_id: int) -> None:
        spark, interval = decided.sparkSession, max(1, self.cfg.control.interval)
        tables = BatchTables(spark, self.base)
        schema = "stream_id string, tick long, threshold double"
        numbers = sorted(r.batch_id for r in decided.select("batch_id").distinct().collect())
        steps = decided.filter(F.col("kind") == TICK).select("stream_id", F.col("t").alias("tick"), "threshold")
        if batch_id:
            steps = steps.unionByName(tables.read("thresholds", batch_id - 1, schema))
        newest = steps.groupBy("stream_id").agg(F.max("tick").alias("tick"), F.max_by("threshold", "tick").alias("threshold"))
        tables.write(newest, "thresholds", batch_id)
        if numbers:
            rows = spark.read.parquet(*[tables.path("scored", n) for n in numbers])
            rows = rows.withColumn("tick", (F.floor(F.col("t") / interval) * interval).cast("long"))
            judged = rows.join(steps, ["stream_id", "tick"], "left").drop("tick")
            judged = judged.withColumn("threshold", F.coalesce("threshold", F.lit(self.cfg.control.initial_threshold)))
            alerts_of(judged).write.mode("overwrite").json(tables.path("alerts", batch_id))
        if batch_id > 1:
            tables.drop("thresholds", batch_id - 2)


def catch_up(
    spark: SparkSession, scored: DataFrame, base: str, cfg: EngineConfig, reference: DataFrame,
    controls: DataFrame | None = None, initial: DataFrame | None = None,
) -> None:
    """Process everything available: index, decide, alert."""
    index_stream(scored, base, cfg, reference, controls).awaitTermination()
    decisions = decision_stream(spark, base, cfg, initial).writeStream.format("parquet").outputMode("append")
    decisions = decisions.option("checkpointLocation", f"{base}/checkpoints/decide").trigger(availableNow=True)
    decisions.start(f"{base}/decisions").awaitTermination()
    settled = spark.readStream.schema(_ddl(DECISION)).parquet(f"{base}/decisions")
    judge = settled.writeStream.foreachBatch(Judge(base, cfg)).trigger(availableNow=True)
    judge.option("checkpointLocation", f"{base}/checkpoints/judge").start().awaitTermination()
