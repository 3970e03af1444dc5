from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry_module
from tidegauge.catalog.oracle import ORACLE
from tidegauge.catalog.queries import QUERIES
from tidegauge.operators import sweep

PHASES = ("normal", "gradual_drift", "sudden_drift")


def evaluations(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        phase = PHASES[i * 3 // n]
        y = int(phase != "normal")
        rows.append((i * 1_000_000, f"e{i:03d}", phase, float(rng.normal(0.6 + 0.5 * y, 0.3)), 0.8, float(np.clip(rng.normal(0.25 + 0.3 * y, 0.15), 0, 1)), y))
    schema = "ts_us long, event_id string, phase string, score double, threshold double, vote_ratio double, ground_truth_drift int"
    return spark.createDataFrame(rows, schema), rows


def replay(rows, p):
    """One parameter set, row by row."""
    warn = crit = False
    wr = cr = 0
    last, out = -(10**9), []
    for i, (_, _, _, s, thr, vote, _) in enumerate(rows):
        hit = (s >= thr * p.warning_exit and vote >= p.warning_vote * 0.8) if warn else (s >= thr * p.warning_enter and vote >= p.warning_vote)
        wr = wr + 1 if hit else 0
        warn = wr >= p.warning_consecutive
        hit = (s >= thr * p.critical_exit and vote >= p.critical_vote * 0.8) if crit else (warn and s >= thr * p.critical_enter and vote >= p.critical_vote)
        cr = cr + 1 if hit else 0
        if crit and hit:
            pass
        elif cr >= p.critical_consecutive and i - last >= p.cooldown:
            crit, last = True, i
        else:
            crit = False
        out.append(crit)
    return out


@pytest.mark.parametrize(("chunk", "together"), [(2000, 256), (5, 2)])
def test_replay_equals_row_by_row(spark, chunk, together, monkeypatch):
    monkeypatch.setattr(sweep, "CHUNKS_TOGETHER", together)
    df, rows = evaluations(spark)
    params = sweep.grid(sweep.SweepParams(cooldown=6))
    split = sweep.split_rows(df)
    folds = {}
    for r in split.orderBy("pos").collect():
        folds.setdefault(r.fold, []).append(next(x for x in rows if x[1] == r.event_id))
    assert set(folds) == {-1, 0, 1, 2} and len(folds[-1]) == 18
    got = {(r.fold, r.param_id): (r.tp, r.fp, r.tn, r.fn) for r in sweep.replay_confusion(split, params, chunk).collect()}
    for fold, part in folds.items():
        for i, p in enumerate(params):
            pred, truth = replay(part, p), [bool(r[6]) for r in part]
            pairs = list(zip(truth, pred))
            want = tuple(sum(x == y for x in pairs) for y in ((True, True), (False, True), (False, False), (True, False)))
            assert got[fold, i] == want


def test_sweep_prefers_the_best_objective(spark):
    df, _ = evaluations(spark)
    top = sweep.sweep(df, sweep.grid()).collect()
    assert [r.place for r in top] == [1, 2, 3, 4, 5]
    assert all(a.objective >= b.objective for a, b in zip(top, top[1:]))


def test_sweep_needs_twenty_rows(spark):
    df, _ = evaluations(spark, 19)
    with pytest.raises(ValueError):
        sweep.split_rows(df)


def test_entry_runs_on_smallest_tables(spark):
    rows = entry_module.entry(spark)
    assert rows.count() == 1000 and rows.filter("status = 'scored'").count() == 850


def test_registered_names_agree():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(QUERIES) <= set(queries) and set(ORACLE) <= set(sql)
    assert len(QUERIES) > 100 and len(QUERIES) - len(ORACLE) <= 4


@pytest.mark.parametrize("name", ["p9_inject_sudden", "d1_first_per_id", "a5_psi_open", "w4_event_index", "t8_lag_circuit"])
def test_queries_equal_their_sql(spark, sf, name):
    from pathlib import Path

    import duckdb

    from check_queries import canonical

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry_module.queries()[name](spark, sf).toPandas()
    assert canonical(got) == canonical(con.sql(entry_module.oracle_sql()[name]).df())
