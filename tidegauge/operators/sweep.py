"""Threshold sweep: hysteresis replay of a parameter grid over logged evaluations."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.folding import Step, ordered_fold
from tidegauge.operators.ordering import event_index
from tidegauge.operators.quality import with_rates
from tidegauge.session import small, stage

# Objective targets and weights, split and fold rules.
FAR_TARGET, FAR_WEIGHT = 0.20, 3.0
PRECISION_TARGET, PRECISION_WEIGHT = 0.75, 2.0
RECALL_TARGET, RECALL_WEIGHT = 0.80, 2.0
SPREAD_WEIGHT = 0.2
TRAIN_SHARE = 0.8
MIN_ROWS, MAX_FOLDS, MIN_FOLDS, ROWS_PER_FOLD = 20, 4, 2, 20
HOLDOUT = -1


@dataclass(frozen=True)
class SweepParams:
    warning_enter: float = 0.8
    warning_exit: float = 0.6
    critical_enter: float = 1.0
    critical_exit: float = 0.8
    warning_vote: float = 0.2
    critical_vote: float = 0.35
    warning_consecutive: int = 1
    critical_consecutive: int = 3
    cooldown: int = 2


def grid(
    base: SweepParams = SweepParams(),
    critical_enter: Sequence[float] = (0.8, 1.0, 1.2),
    critical_vote: Sequence[float] = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60),
    critical_consecutive: Sequence[int] = (1, 2, 3),
) -> list[SweepParams]:
    return [
        replace(base, critical_enter=e, critical_vote=v, critical_consecutive=c)
        for e, v, c in itertools.product(critical_enter, critical_vote, critical_consecutive)
    ]


def grid_table(spark: SparkSession, params: Sequence[SweepParams]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([{"param_id": i, **asdict(p)} for i, p in enumerate(params)]))


REPLAY_SCHEMA = "fold int, param_id long, tp long, fp long, tn long, fn long"
#: Positions per chunk, and chunks whose state maps are composed together.
CHUNK_ROWS = 2_000
CHUNKS_TOGETHER = 256


class Hysteresis:
    """The replay as a finite automaton, for all parameter sets and any number of start states at once.

    A state is the run of warning hits and that of critical hits, each capped at what it needs, the
    critical flag, and the steps since the last entry, capped at the cooldown.
    """

    def __init__(self, params: Sequence[SweepParams]) -> None:
        self.p = {k: np.array([asdict(x)[k] for x in params], dtype=float)[:, None] for k in asdict(params[0])}
        self.warn_need = np.maximum(1, self.p["warning_consecutive"]).astype(int)
        self.crit_need = np.maximum(1, self.p["critical_consecutive"]).astype(int)
        self.wait = np.maximum(0, np.ceil(self.p["cooldown"])).astype(int)
        self.size = len(params)
        self.radix = (int(self.warn_need.max()) + 1, int(self.crit_need.max()) + 1, 2, int(self.wait.max()) + 1)
        self.n_states = int(np.prod(self.radix))

    def unpack(self, states: np.ndarray) -> tuple[np.ndarray, ...]:
        warn, crit, flag, since = np.unravel_index(states, self.radix)
        return np.minimum(warn, self.warn_need), np.minimum(crit, self.crit_need), flag.astype(bool), np.minimum(since, self.wait)

    def pack(self, state: tuple[np.ndarray, ...]) -> np.ndarray:
        warn, crit, flag, since = state
        return np.ravel_multi_index((warn, crit, flag.astype(int), since), self.radix).astype(np.int32)

    def start(self) -> np.ndarray:
        zero = np.zeros((self.size, 1), int)
        return self.pack((zero, zero, zero.astype(bool), self.wait))

    def every(self) -> np.ndarray:
        return np.broadcast_to(np.arange(self.n_states, dtype=np.int32), (self.size, self.n_states))

    def step(self, state: tuple[np.ndarray, ...], score: float, limit: float, vote: float) -> tuple[np.ndarray, ...]:
        p = self.p
        warn, crit, flag, since = state
        leave = (score >= limit * p["warning_exit"]) & (vote >= p["warning_vote"] * 0.8)
        enter = (score >= limit * p["warning_enter"]) & (vote >= p["warning_vote"])
        hit = np.where(warn >= self.warn_need, leave, enter)
        warn = np.where(hit, np.minimum(warn + 1, self.warn_need), 0)
        stay = (score >= limit * p["critical_exit"]) & (vote >= p["critical_vote"] * 0.8)
        enter = (score >= limit * p["critical_enter"]) & (vote >= p["critical_vote"])
        hit = np.where(flag, stay, (warn >= self.warn_need) & enter)
        crit = np.where(hit, np.minimum(crit + 1, self.crit_need), 0)
        staying = flag & hit
        entering = ~staying & (crit >= self.crit_need) & (since >= self.wait)
        since = np.minimum(np.where(entering, 1, since + 1), self.wait)
        return warn, crit, staying | entering, since


def replay_confusion(evaluations: DataFrame, params: Sequence[SweepParams], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Confusion counts of every parameter set per fold.

    ``evaluations``: fold, pos (order inside the fold), score, threshold, vote_ratio, ground_truth_drift.
    All parameter sets advance together as vectors, so the table is never multiplied by the grid. Chunks
    of positions are worked off in parallel: each first gives the end state of every start state; these
    maps are composed, blocks of them in parallel and the blocks in order, which tells every chunk's
    start state; then each chunk counts from there.
    """
    machine = Hysteresis(params)
    columns = ["fold", "pos", "score", "threshold", "vote_ratio", "ground_truth_drift"]
    chunk = F.floor(F.col("pos") / chunk_rows).cast("long")
    rows = stage(evaluations.select(*columns).withColumn("chunk", chunk), "replay")
    shape = (machine.size, machine.n_states)

    def run(pdf: pd.DataFrame, state: tuple, each) -> tuple:
        for row in pdf.sort_values("pos").itertuples(index=False):
            state = machine.step(state, row.score, row.threshold, row.vote_ratio)
            each(row, state)
        return state

    def end_states(pdf: pd.DataFrame) -> pd.DataFrame:
        state = run(pdf, machine.unpack(machine.every()), lambda row, state: None)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "ends": [machine.pack(state).tobytes()]})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        states = machine.every()
        for ends in pdf.sort_values("chunk")["ends"]:
            states = np.take_along_axis(np.frombuffer(ends, np.int32).reshape(shape), states, 1)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "block": [pdf["block"].iloc[0]], "ends": [states.astype(np.int32).tobytes()]})

    def advance() -> Step:
        now = machine.start()

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal now
            starts = []
            for ends in pdf["ends"]:
                starts.append(now.astype(np.int32).tobytes())
                now = np.take_along_axis(np.frombuffer(ends, np.int32).reshape(shape), now, 1)
            return pd.DataFrame({"fold": pdf["fold"], "block": pdf["block"], "start": starts})

        return step

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        now = np.frombuffer(pdf["start"].iloc[0], np.int32).reshape(-1, 1)
        starts = []
        for ends in pdf["ends"]:
            starts.append(now.astype(np.int32).tobytes())
            now = np.take_along_axis(np.frombuffer(ends, np.int32).reshape(shape), now, 1)
        return pd.DataFrame({"fold": pdf["fold"], "chunk": pdf["chunk"], "start": starts})

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((4, machine.size), dtype=np.int64)

        def count(row, state: tuple) -> None:
            critical = state[2][:, 0]
            hit, miss = (0, 3) if row.ground_truth_drift == 1 else (1, 2)
            counts[hit] += critical
            counts[miss] += ~critical

        run(pdf, machine.unpack(np.frombuffer(pdf["start"].iloc[0], np.int32).reshape(-1, 1)), count)
        out = pd.DataFrame(counts.T, columns=["tp", "fp", "tn", "fn"])
        return out.assign(fold=int(pdf["fold"].iloc[0]), param_id=np.arange(machine.size))[["fold", "param_id", "tp", "fp", "tn", "fn"]]

    maps = rows.groupBy("fold", "chunk").applyInPandas(end_states, "fold int, chunk long, ends binary")
    maps = stage(maps.withColumn("block", F.floor(F.col("chunk") / CHUNKS_TOGETHER).cast("long")), "maps")
    blocks = maps.groupBy("fold", "block").applyInPandas(composed, "fold int, block long, ends binary")
    opened = ordered_fold(blocks, ["fold"], "block", advance, "fold int, block long, start binary")
    starts = maps.join(opened, ["fold", "block"]).groupBy("fold", "block").applyInPandas(inside, "fold int, chunk long, start binary")
    partial = rows.join(starts, ["fold", "chunk"]).groupBy("fold", "chunk").applyInPandas(counted, REPLAY_SCHEMA)
    return partial.groupBy("fold", "param_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def split_rows(evaluations: DataFrame) -> DataFrame:
    """Phase-stratified split by time, then folds by position; ``fold`` -1 is the holdout.

    ``evaluations`` carries ts_us, event_id, phase and the replay columns. Positions come from
    the distributed index, not from a global sort.
    """
    n_rows = evaluations.count()
    if n_rows < MIN_ROWS:
        raise ValueError(f"a sweep needs at least {MIN_ROWS} evaluated rows, got {n_rows}")
    ranked = event_index(evaluations, ["phase"], ("ts_us", "event_id"), "_rank")
    sizes = evaluations.groupBy("phase").agg(F.count(F.lit(1)).alias("_size"))
    split = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(TRAIN_SHARE)))
    marked = ranked.join(small(sizes), "phase").withColumn("train", F.col("_rank") <= split)
    indexed = event_index(marked, ["train"], ("ts_us", "event_id"), "_pos")
    n_train = marked.filter("train").count()
    folds = min(MAX_FOLDS, max(MIN_FOLDS, n_train // ROWS_PER_FOLD))
    fold = F.when(F.col("train"), (F.col("_pos") - 1) % folds).otherwise(F.lit(HOLDOUT)).cast("int")
    return indexed.withColumn("fold", fold).withColumn("pos", F.col("_pos")).drop("_rank", "_size", "_pos")


def objective(f1: Column, far: Column, precision: Column, recall: Column) -> Column:
    zero = F.lit(0.0)
    return (
        f1
        - FAR_WEIGHT * F.greatest(zero, far - FAR_TARGET)
        - PRECISION_WEIGHT * F.greatest(zero, PRECISION_TARGET - precision)
        - RECALL_WEIGHT * F.greatest(zero, RECALL_TARGET - recall)
    )


def cross_validated(replayed: DataFrame) -> DataFrame:
    """Mean rates and penalised objective per parameter set over the folds."""
    rates = with_rates(replayed.filter(F.col("fold") != HOLDOUT))
    scored = rates.withColumn(
        "fold_objective", objective(F.col("f1"), F.col("false_alert_rate"), F.col("precision"), F.col("recall"))
    )
    means = scored.groupBy("param_id").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.avg("false_alert_rate").alias("false_alert_rate"),
        (F.avg("fold_objective") - SPREAD_WEIGHT * F.stddev_pop("fold_objective")).alias("objective"),
    )
    return means


def top_params(means: DataFrame, top: int = 5) -> DataFrame:
    """Best parameter sets; equal objectives keep grid order."""
    return means.orderBy(F.desc("objective"), "param_id").limit(top)


def sweep(evaluations: DataFrame, params: Sequence[SweepParams]) -> DataFrame:
    """Top five parameter sets with settings, cross-validated rates and holdout rates."""
    replayed = stage(replay_confusion(split_rows(evaluations), params), "replayed")
    best = top_params(cross_validated(replayed))
    holdout = with_rates(replayed.filter(F.col("fold") == HOLDOUT)).select(
        "param_id", *[F.col(c).alias(f"holdout_{c}") for c in ("precision", "recall", "f1", "false_alert_rate")]
    )
    table = grid_table(evaluations.sparkSession, params)
    order = Window.orderBy(F.desc("objective"), "param_id")
    ranked = best.withColumn("place", F.row_number().over(order))
    return ranked.join(F.broadcast(table), "param_id").join(holdout, "param_id", "left").orderBy("place")
