from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import inputs as I
from tidegauge.operators import ops
from tidegauge.session import drop_staged, small, stage, staging_dir
from tidegauge.sources import events, logs, sinks


def test_label_integrity_counts_null_labels_as_present(spark, tmp_path):
    path = tmp_path / "replay.jsonl"
    path.write_text('{"event_id":"a","ts":1.0,"drift_tag":null}\n{"event_id":"b","ts":2.0}\n')
    rows, check = events.load_replay(spark, str(path))
    assert rows.count() == 2 and check.first().drift_tag_present_all is False
    path.write_text('{"event_id":"a","ts":1.0,"drift_tag":null}\n')
    assert events.load_replay(spark, str(path))[1].first().drift_tag_present_all is True


def test_empty_replay_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    with pytest.raises(ValueError):
        events.load_replay(spark, str(tmp_path / "x.jsonl"))


def test_numbers_as_text_are_accepted_and_null_device_is_not(spark):
    base = '{"event_id":"a","ts":"1.5","entity_id":"e","amount":"2","merchant_id":"m","merchant_category":"c","country":"US","channel":"pos"%s}'
    df = spark.createDataFrame([(base % "",), (base % ',"device_type":null',), (base % ',"device_type":"tv"',), ("[1]",)], "value string")
    good, dead = events.parse_events(df)
    assert good.first().amount == 2.0 and good.count() == 1
    assert sorted(r.reason for r in dead.collect()) == ["device_type_missing", "device_type_unknown", "malformed"]


def test_a_broker_value_is_parsed_once_whatever_the_rules(spark):
    """The filters on the reason must not hold the parser: they would run it for every field of every rule."""
    df = spark.range(4).selectExpr("concat('{\"event_id\":\"', id, '\"') AS value")
    for part in events.parse_events(df):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("jsonObjectKeys(") == 1
    good, dead = events.parse_events(df)
    assert good.isEmpty() and [r.reason for r in dead.collect()] == ["malformed"] * 4


def test_minimal_request_log_gets_defaults(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("timestamp,status_code,latency_ms,ground_truth_drift,fixed_alert,adaptive_alert\n1.5,200,3.25,1,0,1\n")
    row = logs.read_request_log(spark, str(path)).first()
    assert (row.drift_evaluated, row.critical_alert, row.phase, row.score) == (1, 1, "unknown", 0.0)
    assert logs.read_evaluated_requests(spark, str(path)).isEmpty()


def test_feature_csv_roles(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("timestamp,a,b,pred_score,drift_label\n2026-01-01,1,2,0.5,0\n")
    assert logs.read_feature_csv(spark, str(path))[1] == ["a", "b"]
    assert logs.read_feature_csv(spark, str(path), pred_col=None)[1] == ["a", "b", "pred_score"]
    for options in ({"label_col": "nope"}, {"pred_col": "nope"}):
        with pytest.raises(ValueError):
            logs.read_feature_csv(spark, str(path), **options)


def test_scrape_rules(spark, tmp_path):
    (tmp_path / "one.txt").write_text('# HELP x\nx 1\nx 3.5\ny{l="a"} 4\nz abc\nw\n\nv 1e3 123\n')
    (tmp_path / "two.txt").write_text("x 7\n")
    got = {(r.file[-7:], r.metric): r.reading for r in logs.read_scrapes(spark, str(tmp_path)).collect()}
    assert got == {("one.txt", "x"): 3.5, ("one.txt", "v"): 1000.0, ("two.txt", "x"): 7.0}


def test_fixed_precision_rounds_like_c(spark):
    values = [0.00375, 0.125, 2.5, 1234567.891, -0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(sinks.fixed(F.col("v"), 4)).collect()] == [f"{v:.4f}" for v in values]
    assert [r[0] for r in df.select(sinks.fixed(F.col("v"), 2)).collect()] == [f"{v:.2f}" for v in values]


def test_alert_sink_skips_known_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "alert_id string, ts_us long")
    path = str(tmp_path / "alerts")
    for _ in range(2):
        sinks.append_alerts(rows, path)
    got = sorted((r.alert_id, r.ts_us) for r in spark.read.json(path).collect())
    assert got == [("a", 1), ("b", 2)]


def test_feature_score_parsing(spark):
    df = spark.createDataFrame([('{"a":{"psi":0.5}}',), ("[]",), ("",), (None,), ("oops",)], "raw string")
    got = [r[0] for r in df.select(ops.parse_feature_scores(F.col("raw"))).collect()]
    assert got == [{"a": {"psi": 0.5}}, {}, {}, {}, {}]


def test_staging_folder_comes_from_the_session():
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        context = SimpleNamespace(master=master, applicationId="x", getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert staging_dir(session("/shared/stage/", "spark://host")) == "/shared/stage/tidegauge-x"
    with pytest.raises(RuntimeError):
        staging_dir(session(None, "spark://host"))


def test_staged_tables_cut_lineage(spark):
    rows = stage(spark.range(3), "x")
    assert staging_dir(spark) == staging_dir(spark)
    assert rows.count() == 3 and "Range" not in rows._jdf.queryExecution().analyzed().toString()


def test_staged_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidegauge.session.staging_dir", lambda _: f"file://{tmp_path}/app")
    assert stage(spark.range(3), "x").count() == 3 and len(list(tmp_path.glob("app/x-*"))) == 1
    drop_staged(spark)
    assert list(tmp_path.iterdir()) == []


def test_broadcast_only_below_the_limit(spark):
    def hints(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hints(small(spark.range(10), 10)) and not hints(small(spark.range(11), 10))


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = (
        events.canonical_events(spark, sf).filter(F.col("amount") > 500).select("event_id")._jdf.queryExecution().executedPlan().toString()
    )
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,500.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_events_are_valid(spark, sf):
    valid, rejected = events.validate(I.events(spark, sf))
    assert rejected.isEmpty() and valid.count() == 1000
