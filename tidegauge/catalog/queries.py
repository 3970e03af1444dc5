"""Registered queries: name -> (session, table folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.catalog import inputs as I
from tidegauge.config import FEATURES, PHASES
from tidegauge.functions import distance as D
from tidegauge.functions import scalar as S
from tidegauge.operators import adwin, alerts, control, dedupe, drift, features, inject, ops, phases, profile
from tidegauge.operators import quality, samples, sweep, windows
from tidegauge.operators.models import IsolationForestModel
from tidegauge.operators.ordering import event_index, exact_quantiles
from tidegauge.plans import documents, operations, reports
from tidegauge.plans.scoring import ScoringRun
from tidegauge.session import small, stage, staging_dir
from tidegauge.sources import events as E
from tidegauge.sources import logs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as BIGINT: the form both engines are compared in."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            out.append(F.round(c, digits).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(c.cast("long").alias(name))
        else:
            out.append(c)
    return df.select(*out)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------


def _wire(rows: DataFrame) -> Column:
    fields = ["event_id", (F.col("ts_us") / F.lit(1e6)).alias("ts"), "entity_id", "amount", "merchant_id",
              "merchant_category", "country", "channel", "device_type", "drift_tag"]
    return F.struct(*fields)


@query
def s1_jsonl_replay(spark, sf):
    path = new_path(spark, "replay")
    rows = I.events(spark, sf)
    rows.select(_wire(rows).alias("e")).select("e.*").write.json(path)
    back = E.read_replay(spark, path)
    return rounded(back.select("event_id", "ts_us", "entity_id", "amount", "country", "device_type", "drift_tag"))


def _broker_values(spark, sf) -> DataFrame:
    rows = I.events(spark, sf)
    k = I.k_of()
    wire = F.struct(
        "event_id", (F.col("ts_us") / F.lit(1e6)).alias("ts"), "entity_id",
        F.when(k == 21, -F.col("amount")).otherwise(F.col("amount")).alias("amount"), "merchant_id",
        F.when(k != 23, F.col("merchant_category")).alias("merchant_category"), "country",
        F.when(k == 22, F.lit("fax")).otherwise(F.col("channel")).alias("channel"),
        F.when(k != 24, F.col("device_type")).alias("device_type"), "drift_tag",
    )
    text = F.to_json(wire)
    return rows.select(F.when(k == 20, F.substring(text, 1, 30)).otherwise(text).alias("value"))


@query
def s2_parse_broker_values(spark, sf):
    return _outcomes(*E.parse_events(_broker_values(spark, sf)))


def _outcomes(good: DataFrame, dead: DataFrame) -> DataFrame:
    ok = good.groupBy("device_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("amount"), 2).alias("amount"))
    bad = dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return ok.select(F.lit("ok").alias("outcome"), F.col("device_type").alias("detail"), "n", "amount").unionByName(
        bad.select(F.lit("dead_letter").alias("outcome"), F.col("reason").alias("detail"), "n", F.lit(0.0).alias("amount"))
    )


@query
def s4_validate_events(spark, sf):
    k = I.k_of()
    rows = I.events(spark, sf).withColumns(
        {
            "amount": F.when(k % 10 == 0, -F.col("amount")).otherwise(F.col("amount")),
            "channel": F.when(k % 11 == 0, F.lit("fax")).otherwise(F.col("channel")),
            "country": F.when(k % 13 != 0, F.col("country")),
            "device_type": F.when(k % 7 == 0, F.lit(None)).when(k % 17 == 0, F.lit("watch")).otherwise(F.col("device_type")),
        }
    )
    valid, rejected = E.validate(rows)
    return (
        valid.groupBy(F.lit("valid").alias("outcome"), F.col("device_type").alias("detail"))
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(rejected.groupBy(F.lit("rejected").alias("outcome"), F.col("reason").alias("detail")).agg(F.count(F.lit(1)).alias("n")))
    )


@query
def s5_label_integrity(spark, sf):
    rows = I.events(spark, sf)
    wire = _wire(rows)
    with_null = F.to_json(wire, {"ignoreNullFields": "false"})
    without = F.to_json(wire.dropFields("drift_tag"))
    lines = rows.select("merchant_category", F.when(I.k_of() == 5, without).otherwise(with_null).alias("value"))
    whole = E.label_integrity(lines.filter(F.col("value").contains('"drift_tag"')))
    mixed = E.label_integrity(lines)
    return whole.select(F.lit("complete").alias("replay"), "*").unionByName(mixed.select(F.lit("mixed").alias("replay"), "*"))


@query
def s6_feature_csv(spark, sf):
    path = new_path(spark, "features")
    table = I.feature_table(spark, sf).select("ts_us", *I.FEATURE_COLUMNS, "pred_score", "drift_label")
    table.withColumnRenamed("ts_us", "timestamp").write.option("header", True).csv(path)
    rows, names = logs.read_feature_csv(spark, path)
    long = profile.long_form(rows, ["drift_label"], names)
    out = long.groupBy("feature", "drift_label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rounded(out.withColumn("drift_label", F.col("drift_label").cast("long")), 4)


@query
def s7_request_log(spark, sf):
    path = new_path(spark, "requests")
    sinks.write_request_log(I.requests(spark, sf).drop("ts_us"), path)
    rows = logs.read_request_log(spark, path)
    return rounded(
        rows.groupBy("endpoint", "status_code").agg(
            F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency"), F.min("timestamp").alias("first"),
            F.sum("drift_evaluated").alias("evaluated"), F.count_if(F.col("feature_scores_json").startswith("{")).alias("with_scores"),
        ),
        4,
    )


@query
def s7_resource_log(spark, sf):
    path = new_path(spark, "resources")
    rows = I.resources(spark, sf)
    sinks.write_resource_log(rows.drop("host"), path)
    back = logs.read_resource_log(spark, path)
    return rounded(
        back.agg(
            F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"),
            F.sum("process_cpu_percent").alias("percent"), F.max("process_cpu_seconds_total").alias("cpu"),
        ),
        4,
    )


@query
def s8_scrape(spark, sf):
    k = I.k_of()
    value = F.format_string("%.2f", F.col("amount"))
    line = (
        F.when(k % 6 == 0, F.lit("# HELP events_scored_total scored events"))
        .when(k % 6 == 1, F.concat(F.lit('alerts_emitted_total{severity="low"} '), value))
        .when(k % 6 == 2, F.concat(F.lit("events_scored_total "), value))
        .when(k % 6 == 3, F.concat(F.lit("current_threshold "), value))
        .when(k % 6 == 4, F.lit("drift_active maybe"))
        .otherwise(F.lit(""))
    )
    path = new_path(spark, "scrapes")
    I.events(spark, sf).select(line.alias("value")).write.text(path)
    rows = logs.parse_scrape(spark.read.text(path))
    return rounded(rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("reading").alias("total")), 2)


@query
def s9_alert_sink(spark, sf):
    path = new_path(spark, "alerts")
    rows = alerts.alerts_of(_scored_at_fixed(spark, sf)).select("alert_id", "ts_us", "event_id", "severity")
    sinks.append_alerts(rows.unionByName(rows), path)
    sinks.append_alerts(rows, path)
    return sinks.read_alerts(spark, path, rows.schema)


@query
def s10_labelled_stream(spark, sf):
    name, label = phases.phase_by_share(I.run_share())
    rows = sinks.labelled_stream(I.events(spark, sf), name, label)
    nested, flat = new_path(spark, "labelled"), new_path(spark, "labelled")
    sinks.write_labelled_json(rows, nested)
    sinks.write_labelled_csv(rows, flat)
    a = spark.read.schema(rows.schema).json(nested).select("request_id", "phase", "ground_truth_drift", "event.amount", "event.drift_tag")
    event = F.from_json("event_json", rows.schema["event"].dataType)
    b = spark.read.option("header", True).option("escape", '"').csv(flat).select("request_id", event.alias("e"))
    both = a.join(b, "request_id")
    return rounded(
        both.groupBy("phase", "ground_truth_drift", "drift_tag").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sum("e.amount").alias("amount_flat")
        ),
        2,
    )


@query
def s11_fixed_precision(spark, sf):
    rows = sinks.with_decimals(I.requests(spark, sf), sinks.REQUEST_DECIMALS)
    return rows.select("request_id", "timestamp", "latency_ms", "vote_ratio", "score")


@query
def s12_summary_sink(spark, sf):
    path = new_path(spark, "summary")
    tables = ops.run_summary(I.requests(spark, sf))
    sinks.write_summary(tables.select(F.struct("requests_total", "requests_ok").alias("volume"), "latency_p95_ms"), path)
    back = spark.read.json(path)
    return rounded(back.select("volume.requests_total", "volume.requests_ok", "latency_p95_ms"))


def _reread(spark, document: DataFrame) -> DataFrame:
    """A document after a round trip through its file."""
    path = new_path(spark, "document")
    sinks.write_summary(document, path)
    return spark.read.json(path)


@query
def s12_run_document(spark, sf):
    tables = reports.evaluate_run(I.requests(spark, sf))
    doc = _reread(spark, documents.run_document(tables))
    both = F.explode(F.array("baseline_vs_adaptive.fixed_baseline", "baseline_vs_adaptive.adaptive")).alias("d")
    rows = doc.select(both, "requests_total", "latency_p95_ms", "phase_label_verification", F.size("phase_metrics").alias("phases"))
    figures = rows.select(*[f"d.{c}" for c in ("detector", "tp", "fp", "fn", "tn")], *[F.round(f"d.{c}", 3).alias(c) for c in ("precision", "recall")],
                          "requests_total", F.round("latency_p95_ms", 4).alias("latency_p95_ms"), "phase_label_verification", "phases")
    check = ("checked_rows", "mismatches", "valid")
    return rounded(figures.select("*", *[f"phase_label_verification.{c}" for c in check]).drop("phase_label_verification"))


@query
def s12_sweep_document(spark, sf):
    doc = _reread(spark, documents.sweep_document(QUERIES["c6_threshold_sweep"](spark, sf)))
    best = QUERIES["c6_threshold_sweep"](spark, sf).columns
    return doc.select(F.explode("top").alias("t")).select(*[f"t.{c}" for c in best])


@query
def s12_report_document(spark, sf):
    windows = stage(_psi_windows(spark, sf), "windows")
    report = rounded(reports.psi_report(windows), 4)
    doc = _reread(spark, documents.report_document(report, windows))
    return doc.select(F.explode("detectors").alias("d"), "windows", "first_us").select(*[f"d.{c}" for c in report.columns], "windows", "first_us")


# --- scalar functions --------------------------------------------------------------------


@query
def p1_stable_id(spark, sf):
    rows = I.events(spark, sf)
    return rows.select("event_id", S.stable_id(F.lit("alert"), F.col("event_id"), F.col("ts_us")).alias("sid"))


def _odd_values(spark, sf) -> DataFrame:
    """Amounts with NaN, infinities, nulls and very large values strewn in."""
    k = I.k_of()
    odd = (
        F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf")))
        .when(k == 3, F.lit(None)).when(k == 4, F.col("amount") * 1e9).otherwise(F.col("amount"))
    )
    return I.events(spark, sf).select("event_id", "merchant_id", odd.alias("x"))


@query
def p2_vector_guard(spark, sf):
    return rounded(_odd_values(spark, sf).select("event_id", S.guard("x").alias("guarded")))


@query
def p3_normalized_scores(spark, sf):
    return rounded(I.run(spark, sf).scored.select("event_id", "score"))


def _with_thresholds(spark, sf) -> DataFrame:
    k = I.k_of()
    return I.events(spark, sf).select("event_id", (F.col("amount") / 200.0).alias("score"), (k / 100.0).alias("threshold"))


@query
def p4_severity(spark, sf):
    rows = _with_thresholds(spark, sf)
    return rows.select("event_id", S.severity(F.col("score"), F.col("threshold")).alias("severity"))


@query
def p5_hash_sample(spark, sf):
    rows = I.events(spark, sf)
    return rows.select(
        "event_id", S.hash_sampled(F.col("event_id"), 0.1).alias("tenth"), S.hash_sampled(F.col("event_id"), 1.0).alias("whole"),
        S.hash_sampled(F.col("event_id"), 0.0).alias("none"),
    )


FIXED_THRESHOLD = 0.99


def _scored_at_fixed(spark, sf) -> DataFrame:
    return I.run(spark, sf).scored.withColumn("threshold", F.lit(FIXED_THRESHOLD))


@query
def p6_alerts(spark, sf):
    rows = alerts.alerts_of(_scored_at_fixed(spark, sf))
    return rounded(
        rows.select(
            "alert_id", "event_id", "entity_id", "ts_us", "score", "threshold", "severity", "reason",
            F.col("metadata")["merchant_category"].alias("category"), F.col("metadata")["country"].alias("country"),
            F.col("metadata")["channel"].alias("channel"),
        )
    )


@query
def p7_phase_labels(spark, sf):
    """Also the range join on the phase table."""
    elapsed = I.run_share() * 660.0
    rows = I.events(spark, sf).select("event_id", elapsed.alias("elapsed"))
    return rounded(phases.label_phases(rows, "elapsed", phases.phase_table(spark, PHASES)).drop("elapsed", "pattern"))


@query
def p7_phase_by_share(spark, sf):
    name, label = phases.phase_by_share(I.run_share())
    return I.events(spark, sf).select("event_id", name.alias("phase"), label.cast("long").alias("label"))


@query
def p8_label_rules(spark, sf):
    tag = F.when(I.k_of() % 9 == 0, F.lit("")).otherwise(F.col("drift_tag"))
    return I.events(spark, sf).select("event_id", S.tag_present(tag).alias("present"), S.tag_truthy(tag).alias("truthy"))


def _injected(pattern: str) -> Query:
    def run(spark, sf):
        where = F.col("ts_us").between(I.DRIFT_FROM, I.DRIFT_TO)
        progress = (F.col("ts_us") - I.DRIFT_FROM) / F.lit(float(I.DRIFT_TO - I.DRIFT_FROM))
        rows = inject.inject(E.canonical_events(spark, sf), pattern, where, progress)
        return rounded(rows.select("event_id", "amount", "merchant_category", "country", "drift_tag"))

    return run


for _pattern in inject.PATTERNS[1:]:
    QUERIES[f"p9_inject_{_pattern}"] = _injected(_pattern)


@query
def p9_shift_columns(spark, sf):
    rows = I.feature_table(spark, sf)
    return rounded(
        rows.groupBy("drift_label").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*I.FEATURE_COLUMNS, "pred_score")],
            F.min("pred_score").alias("low"), F.max("pred_score").alias("high"),
        ),
        4,
    )


@query
def p10_ks_critical(spark, sf):
    n = F.col("merchant_id").cast("long")
    m = F.col("entity_id").cast("long") + 1
    return rounded(I.events(spark, sf).select("event_id", D.ks_critical(n, m, 0.001).alias("critical")))


@query
def p11_enabled_features(spark, sf):
    cfg = replace(I.CONFIG.features, enabled=("cnt_5m", "rate_per_min"))
    rows = features.entity_features(I.events(spark, sf), cfg)
    return rounded(rows.select("event_id", "cnt_5m", F.col("rate_per_min") + 1e-8).toDF("event_id", "cnt_5m", "rate_per_min"))


@query
def p12_processing_lag(spark, sf):
    return rounded(I.lags(spark, sf).select("event_id", "lag_s"))


@query
def p13_feature_scores(spark, sf):
    scores = ops.parse_feature_scores(F.col("feature_scores_json"))
    rows = I.requests(spark, sf)
    return rounded(rows.select("request_id", F.size(scores).cast("long").alias("features"), scores["amt"]["psi"].alias("psi"), scores["amt"]["ks"].alias("ks")))


@query
def p14_damped_ratio(spark, sf):
    return rounded(I.events(spark, sf).select("event_id", S.damped(F.col("amount") / 10.0 - 1.0, 3.0).alias("norm")))


@query
def p15_finite(spark, sf):
    return _odd_values(spark, sf).select("event_id", S.is_finite(F.col("x")).alias("finite"))


# --- deduplication and row selection -----------------------------------------------------


def _with_copies(spark, sf) -> DataFrame:
    rows = I.events(spark, sf).withColumn("source", F.when(I.k_of() % 2 == 0, "stream").otherwise("api"))
    late = rows.filter(I.k_of() % 3 == 0).withColumns({"ts_us": F.col("ts_us") + 5 * I.US, "amount": F.col("amount") + 1.0})
    hot = rows.filter(I.k_of() % 5 == 0)
    return rows.unionByName(late).unionByName(hot)


@query
def d1_first_per_id(spark, sf):
    return rounded(dedupe.first_per_id(_with_copies(spark, sf)).select("event_id", "ts_us", "amount", "source"))


@query
def d2_duplicate_counts(spark, sf):
    return dedupe.duplicate_counts(_with_copies(spark, sf), ["source"])


@query
def d3_alert_dedupe(spark, sf):
    rows = alerts.alerts_of(_scored_at_fixed(spark, sf)).select("alert_id", "ts_us", "severity")
    twice = rows.unionByName(rows.filter(F.col("severity") == "high"))
    return dedupe.first_per_id(twice, "alert_id")


@query
def d4_evaluated_rows(spark, sf):
    rows = ops.evaluated_rows(I.requests(spark, sf))
    return rows.groupBy("endpoint", "drift_evaluated").agg(F.count(F.lit(1)).alias("n")).withColumn("drift_evaluated", F.col("drift_evaluated").cast("long"))


@query
def d4_evaluated_fallback(spark, sf):
    rows = ops.evaluated_rows(I.requests(spark, sf).withColumn("drift_evaluated", F.lit(0)))
    return rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


@query
def d5_misclassified(spark, sf):
    rows = quality.misclassified(I.requests(spark, sf), "ground_truth_drift", "critical_alert")
    scores = ops.parse_feature_scores(F.col("feature_scores_json"))
    return rounded(rows.select("request_id", "phase", "error_kind", "score", "vote_ratio", scores["amt"]["psi"].alias("psi")))


@query
def d5_misclassified_counts(spark, sf):
    return quality.misclassified_counts(quality.misclassified(I.requests(spark, sf), "ground_truth_drift", "critical_alert"))


# --- pairings ----------------------------------------------------------------------------


@query
def j2_threshold_in_force(spark, sf):
    return rounded(I.run(spark, sf).judged.select("event_id", "t", "threshold", "is_anomaly"))


@query
def j3_latest_action(spark, sf):
    rows = I.events(spark, sf).select("stream_id", "ts_us", "event_id")
    return control.latest_action(rows, I.controls(spark, sf)).select("event_id", "last_action", "frozen")


@query
def j4_baseline_vs_tuned(spark, sf):
    rows = I.requests(spark, sf)
    truth = F.col("ground_truth_drift") == 1
    base = quality.confusion(rows, truth, F.col("fixed_alert") == 1, ["phase"]).select("phase", F.col("fp").alias("baseline_fp"))
    tuned = quality.confusion(rows, truth, F.col("critical_alert") == 1, ["phase"]).select("phase", F.col("fp").alias("tuned_fp"))
    both = base.join(tuned, "phase")
    return rounded(both.withColumn("reduction", quality.fp_reduction(F.col("baseline_fp"), F.col("tuned_fp"))))


@query
def j6_zero_filled_severity(spark, sf):
    rows = alerts.alerts_of(_scored_at_fixed(spark, sf))
    return ops.counter(rows, "severity", ops.SEVERITIES)


# --- distribution statistics -------------------------------------------------------------


@query
def a1_reference_profile(spark, sf):
    edges = profile.decile_edges(I.halves(spark, sf)[0], ["feature"], bounded=False)
    return rounded(edges.select("feature", *[F.col("edges")[i].alias(f"e{i}") for i in range(11)], "n", "mean", "std"))


@query
def a1_exact_quantiles_distributed(spark, sf):
    """With small slices, so that the running counts span many of them."""
    probs = {f"q{int(p * 100)}": p for p in (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)}
    return rounded(exact_quantiles(I.halves(spark, sf)[0], ["feature"], "value", probs, target_rows=500))


@query
def a2_histogram(spark, sf):
    ref, cur = I.halves(spark, sf)
    edges = profile.decile_edges(ref, ["feature"], bounded=False).select("feature", "edges")
    rows = cur.join(small(edges), "feature").withColumn("bin", D.bin_of("value", "edges"))
    return rows.groupBy("feature", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query
def a3_psi_widened(spark, sf):
    ref, cur = I.halves(spark, sf)
    return rounded(samples.psi_verdict(samples.psi_widened(ref, cur, ["feature"]), 0.02))


@query
def a5_psi_open(spark, sf):
    ref, cur = I.halves(spark, sf)
    odd = F.when(F.col("value") > 200.0, F.lit(float("inf"))).when(F.col("value") < 1.0, F.lit(float("nan"))).otherwise(F.col("value"))
    return rounded(samples.psi_open(ref, cur.withColumn("value", odd), ["feature"]))


@query
def a7_a8_ks(spark, sf):
    ref, cur = I.halves(spark, sf)
    out = samples.ks_distances(ref, cur, ["feature"], 0.001)
    return rounded(out.select("feature", "n_ref", "n_cur", "ks", "ks_step", "ks_critical", "p_value", "triggered"))


@query
def a4_a6_a9_window_distances(spark, sf):
    return rounded(I.run(spark, sf).distances.select("u", "feature", "n_cur", "psi", "ks", "ks_critical", "mean_shift_z"), 5)


@query
def a10_profile_moments(spark, sf):
    rows = I.run(spark, sf).profile
    return rounded(rows.select("feature", "n", F.col("mean") + 1e-8, "std").toDF("feature", "n", "mean", "std"), 5)


@query
def a4_profile_shares(spark, sf):
    rows = I.run(spark, sf).profile
    return rounded(rows.select("feature", F.posexplode("ref_perc")).toDF("feature", "bin", "share"))


@query
def a11_zscore_model(spark, sf):
    return rounded(I.run(spark, sf).model.params.select("n", "norm_mean", "norm_scale"), 4)


@query
def a12_normalizer(spark, sf):
    return rounded(I.run(spark, sf).model.params.select("raw_mean", "raw_std"))


@query
def a13_percentiles(spark, sf):
    return rounded(exact_quantiles(I.requests(spark, sf), ["endpoint"], "latency_ms", ops.LATENCY_LEVELS))


def _fixed_judged(spark, sf) -> DataFrame:
    return _scored_at_fixed(spark, sf).withColumn("is_anomaly", F.col("score") >= F.col("threshold"))


@query
def a14_alert_quality(spark, sf):
    rows = _fixed_judged(spark, sf)
    out = quality.alert_quality(rows, F.col("is_anomaly"), S.tag_truthy(F.col("drift_tag")), ["merchant_category"])
    return rounded(out)


@query
def a14_alert_quality_unlabelled(spark, sf):
    rows = quality.alert_quality(_fixed_judged(spark, sf), F.col("is_anomaly"), None, ["merchant_category"])
    return rounded(rows.withColumns({c: F.col(c).isNull() for c in ("tp", "fp", "fn", "tn", "drift_events", "non_drift_events")}))


@query
def a15_confusion(spark, sf):
    rows = I.requests(spark, sf)
    return rounded(quality.confusion(rows, F.col("ground_truth_drift") == 1, F.col("critical_alert") == 1, ["endpoint"]))


@query
def a16_phase_confusion(spark, sf):
    rows = I.requests(spark, sf)
    return rounded(quality.confusion(rows, F.col("ground_truth_drift") == 1, F.col("critical_alert") == 1, ["phase"]))


def _delay(after: bool, rate: float | None) -> Query:
    def run(spark, sf):
        rows = _fixed_judged(spark, sf)
        out = quality.detection_delay(
            rows, "t", "ts_us", S.tag_truthy(F.col("drift_tag")), F.col("is_anomaly"), ["merchant_category"], after, rate
        )
        return rounded(out, 3)

    return run


QUERIES["a17_detection_delay"] = _delay(False, None)
QUERIES["a17_detection_delay_after_onset"] = _delay(True, None)
QUERIES["a17_detection_delay_by_rate"] = _delay(True, 585.0)


@query
def a18_fp_reduction(spark, sf):
    rows = I.requests(spark, sf)
    truth = F.col("ground_truth_drift") == 1
    counts = rows.groupBy("endpoint").agg(
        F.count_if(~truth & (F.col("fixed_alert") == 1)).alias("base"), F.count_if(~truth & (F.col("critical_alert") == 1)).alias("tuned")
    )
    return rounded(
        counts.select(
            "endpoint", quality.fp_reduction(F.col("base"), F.col("tuned")).alias("reduction"),
            quality.fp_reduction_floored(F.col("base"), F.col("tuned")).alias("reduction_floored"),
        )
    )


@query
def a19_gates(spark, sf):
    rows = _fixed_judged(spark, sf).groupBy("merchant_category").agg(
        F.avg(F.col("is_anomaly").cast("double")).alias("rate"), F.count_if("is_anomaly").alias("alerts"),
        F.avg("amount").alias("a"), F.avg("score").alias("b"),
    )
    hard, _ = quality.hard_rate_gate(F.col("rate"))
    near, _ = quality.target_rate_gate(F.col("rate"), F.lit(0.05), 0.03)
    waived, _ = quality.target_rate_gate(F.col("rate"), F.lit(0.5), 0.001, F.col("alerts") > 80)
    perf = quality.performance_gate(F.col("a"), F.col("a") * F.col("b"), F.col("b"), F.col("b") * 1.1)
    return rounded(
        rows.select(
            "merchant_category", hard.alias("hard"), near.alias("near"), waived.alias("waived"),
            *[c.alias(n) for n, c in perf.items()], quality.sample_gate(F.col("alerts"), F.lit(True), 70).alias("enough"),
        )
    )


@query
def a20_run_summary(spark, sf):
    return rounded(ops.run_summary(I.requests(spark, sf)), 4)


@query
def a21_cpu_memory(spark, sf):
    return rounded(ops.cpu_memory(I.resources(spark, sf)), 4)


@query
def a22_traffic_mix(spark, sf):
    return ops.traffic_mix(I.requests(spark, sf))


@query
def a23_ingest_counters(spark, sf):
    return ops.counter(_with_copies(spark, sf), "source", ops.SOURCES)


@query
def a23_operational_counters(spark, sf):
    dead = {"kafka": E.parse_events(_broker_values(spark, sf))[1]}
    return operations.operational_counters(I.run(spark, sf), _with_copies(spark, sf), dead, I.controls(spark, sf))


@query
def a24_latency_histograms(spark, sf):
    requests = I.requests(spark, sf).filter(ops.is_ok(F.col("status_code"))).withColumn("seconds", F.col("latency_ms") / 1000.0)
    tables = {
        "score_latency_seconds": (requests, "seconds", ops.SCORE_LATENCY_EDGES),
        "processing_lag_seconds": (I.lags(spark, sf), "lag_s", ops.LAG_EDGES),
    }
    return rounded(operations.latency_histograms(tables), 4)


@query
def a24_lag_histogram(spark, sf):
    return rounded(ops.cumulative_histogram(I.lags(spark, sf), "lag_s", ops.LAG_EDGES), 4)


def _component_times(spark, sf) -> DataFrame:
    k = I.k_of()
    a = F.col("amount")
    return I.events(spark, sf).select(
        F.when(k % 2 == 0, "baseline").otherwise("tuned").alias("run"), (a / 1e4).alias("features"), (a / 1e2 + k % 2).alias("scoring"),
        (k / 1e4).alias("change_detection"), (k / 1e3 + k % 2 * 0.5).alias("distances"), (a / 1e5).alias("control"),
    )


COMPONENTS = ("features", "scoring", "change_detection", "distances", "control")


@query
def a25_component_profile(spark, sf):
    return rounded(ops.component_profile(_component_times(spark, sf), COMPONENTS))


@query
def a25_top_regressions(spark, sf):
    """Also the top-3 limit."""
    table = ops.component_profile(_component_times(spark, sf), COMPONENTS)
    return rounded(ops.top_regressions(table, "baseline", "tuned"))


@query
def a26_phase_label_check(spark, sf):
    return phases.verify_phase_labels(I.requests(spark, sf))


@query
def a27_availability(spark, sf):
    k = I.k_of()
    return rounded(I.events(spark, sf).select("event_id", ops.availability_percent((k - 10).cast("double"), F.col("amount") - 30.0).alias("availability")))


@query
def a28_state_summary(spark, sf):
    return rounded(I.run(spark, sf).state_summary(I.lags(spark, sf), _with_copies(spark, sf), I.controls(spark, sf)))


@query
def a29_recent_rate(spark, sf):
    judged = _scored_at_fixed(spark, sf)
    return rounded(control.recent_rate(judged, I.CONFIG.control))


def _latency_series(spark, sf) -> DataFrame:
    rows = event_index(I.requests(spark, sf).withColumn("stream_id", F.lit("run")), order=("ts_us", "request_id"))
    return windows.rolling_percentile(rows, ["stream_id"], "idx", "latency_ms", 0.95, 1000, 250, "rolling_p95_ms")


@query
def a30_rolling_summary(spark, sf):
    return rounded(windows.series_summary(_latency_series(spark, sf), ["stream_id"], "idx", "rolling_p95_ms"))


# --- windows -----------------------------------------------------------------------------


def _features_out(rows: DataFrame) -> DataFrame:
    shift = {"amt_mean_5m", "rate_per_min", "amt_std_5m"}
    return rows.select("event_id", *[r6(F.col(f) + 1e-8 if f in shift else F.col(f)).alias(f) for f in FEATURES])


@query
def w1_entity_features(spark, sf):
    return _features_out(features.entity_features(I.events(spark, sf), I.CONFIG.features))


@query
def w1_entity_features_capped(spark, sf):
    """A cap small enough to bind for most rows."""
    cfg = replace(I.CONFIG.features, max_events=8)
    return _features_out(features.entity_features(I.events(spark, sf), cfg))


@query
def w1_entity_features_range(spark, sf):
    return _features_out(features.entity_features_range(I.events(spark, sf), I.CONFIG.features))


@query
def w1_entity_features_range_capped(spark, sf):
    """The frames with a cap small enough to bind for most rows."""
    cfg = replace(I.CONFIG.features, max_events=8)
    return _features_out(features.entity_features_range(I.events(spark, sf), cfg))


@query
def w2_time_since_last(spark, sf):
    cfg = replace(I.CONFIG.features, since_last="lag", enabled=("time_since_last",))
    rows = features.entity_features(I.events(spark, sf), cfg)
    return rounded(rows.select("event_id", S.guard("time_since_last").alias("gap_s")))


@query
def w3_window_contents(spark, sf):
    rows = features.window_contents(I.events(spark, sf), I.CONFIG.features)
    return rounded(
        rows.select(
            "event_id", F.size("window").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("window", lambda x: x["amount"])), F.lit(0.0)).alias("top"),
            F.coalesce(F.get("window", F.lit(0))["ts_us"], F.lit(-1)).alias("oldest_us"),
        )
    )


@query
def w4_event_index(spark, sf):
    """The sliced path, forced by a small slice size."""
    rows = event_index(I.events(spark, sf), target_rows=500)
    idx = F.col("idx")
    phase = F.when(idx <= 1500, "warming_up").when(idx <= 3500, "reference").otherwise("current")
    return rows.select("event_id", "idx", phase.alias("phase"))


@query
def w6_count_windows(spark, sf):
    rows = windows.count_windows(I.indexed_features(spark, sf).select("idx", "feature_1"), 5000, 1000, 250)
    return rounded(rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.avg("feature_1").alias("mean")), 4)


def _psi_windows(spark, sf) -> DataFrame:
    return reports.psi_windows(I.indexed_features(spark, sf), I.FEATURE_COLUMNS, "pred_score", window_size=500, step_size=500)


@query
def w7_window_psi(spark, sf):
    rows = windows.window_psi(I.indexed_features(spark, sf), I.FEATURE_COLUMNS, "pred_score", "drift_label", 5000, 1000, 500)
    return rounded(rows)


@query
def w8_trailing_threshold(spark, sf):
    return rounded(_psi_windows(spark, sf).select("window_id", "max_psi", "adaptive_threshold", "alert_fixed", "alert_adaptive"))


STREAMS = ("stream_id",)


def _stream_windows(spark, sf) -> DataFrame:
    """Windows over three streams of feature rows at once."""
    rows = event_index(I.feature_streams(spark, sf), order=I.FEATURE_ORDER)
    return reports.psi_windows(rows, I.FEATURE_COLUMNS, "pred_score", window_size=500, step_size=500, by=STREAMS)


@query
def w8_trailing_threshold_streams(spark, sf):
    rows = _stream_windows(spark, sf)
    return rounded(rows.select("stream_id", "window_id", "start_us", "true_drift", "max_psi", "adaptive_threshold", "alert_fixed", "alert_adaptive"))


@query
def c2_drift_report_streams(spark, sf):
    return rounded(reports.psi_report(_stream_windows(spark, sf), STREAMS), 4)


@query
def w10_drift_segments_streams(spark, sf):
    rows = I.requests(spark, sf).withColumn("stream_id", F.col("endpoint"))
    numbered = event_index(rows, order=("ts_us", "request_id"))
    found = quality.drift_segments(numbered, "idx", "ts_us", "ground_truth_drift", "critical_alert", STREAMS)
    return rounded(found.select("stream_id", "first_pos", "last_pos", "start_us", "detected", F.coalesce("detected_pos", F.lit(-1)).alias("detected_pos")))


@query
def a13_percentiles_odd_values(spark, sf):
    """Infinite and NaN values, in slices small enough that they would fill some."""
    odd = F.when(F.col("value") > 200.0, F.lit(float("inf"))).when(F.col("value") < 1.0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = I.halves(spark, sf)[0].withColumn("value", odd)
    return rounded(exact_quantiles(rows, ["feature"], "value", {"low": 0.0, "mid": 0.5, "top": 1.0}, target_rows=200))


@query
def w9_trailing_alerts(spark, sf):
    rates = windows.trailing_alert_rate(_fixed_judged(spark, sf).filter("is_anomaly"), ["stream_id"], 3600)
    return rates.select("ts_us", "alerts_now", "alerts_trailing")


@query
def w9_alert_rate_summary(spark, sf):
    rates = windows.trailing_alert_rate(_fixed_judged(spark, sf).filter("is_anomaly"), ["stream_id"], 3600)
    return rounded(windows.alert_rate_summary(rates, ["stream_id"], 5.0))


def _numbered_requests(spark, sf) -> DataFrame:
    return event_index(I.requests(spark, sf).withColumn("stream_id", F.lit("run")), order=("ts_us", "request_id"))


@query
def w10_drift_segments(spark, sf):
    rows = quality.drift_segments(_numbered_requests(spark, sf), "idx", "ts_us", "ground_truth_drift", "critical_alert")
    return rounded(rows.drop("latency_windows").na.fill(-1, ["detected_pos", "detected_us"]))


@query
def w10_segment_summary(spark, sf):
    rows = quality.drift_segments(_numbered_requests(spark, sf), "idx", "ts_us", "ground_truth_drift", "critical_alert")
    return rounded(quality.segment_summary(rows).drop("avg_latency_windows"), 3)


@query
def w11_rolling_latency(spark, sf):
    return rounded(_latency_series(spark, sf).select("idx", "rolling_p95_ms"))


@query
def w13_running_quality(spark, sf):
    rows = I.run(spark, sf).evaluations.withColumn("truth", S.tag_truthy(F.col("drift_tag")))
    out = quality.running_quality(rows, F.col("truth"), F.col("drift_active"))
    return rounded(out.select("u", "run_tp", "run_fp", "run_true", "run_precision", "run_recall"))


# --- sorts and limits --------------------------------------------------------------------


@query
def l1_newest_alerts(spark, sf):
    return ops.newest_alerts(alerts.alerts_of(_scored_at_fixed(spark, sf)), 500).select("alert_id", "ts_us", "severity")


@query
def l3_requests_by_time(spark, sf):
    return I.requests(spark, sf).select("request_id", r6("timestamp").alias("timestamp"), r6("latency_ms").alias("latency_ms")).orderBy("timestamp")


# --- sequential operators ----------------------------------------------------------------


@query
def t1_drift_fusion(spark, sf):
    rows = drift.fused_at_fixed_limits(I.run(spark, sf).distances, I.CONFIG.drift, len(FEATURES))
    return rounded(rows.drop("stream_id", "t"), 5)


@query
def t2_t3_drift_states(spark, sf):
    cols = ("u", "drift_score", "drift_threshold", "vote_ratio", "mean_fusion", "drift_fixed_active", "drift_warning_active", "drift_active")
    rows = drift.evaluation_rows(I.run(spark, sf).distances, FEATURES).withColumn("adwin_detected", F.lit(False))
    return rounded(drift.drift_states(rows, I.CONFIG.drift).select(*cols), 5)


@query
def t2_t3_drift_states_chunked(spark, sf):
    """Chunks far shorter than a history, which take several rounds to agree."""
    cols = ("u", "drift_score", "drift_threshold", "vote_ratio", "mean_fusion", "drift_fixed_active", "drift_warning_active", "drift_active")
    rows = drift.evaluation_rows(I.run(spark, sf).distances, FEATURES).withColumn("adwin_detected", F.lit(False))
    return rounded(drift.drift_states(rows, I.CONFIG.drift, chunk=12).select(*cols), 5)


@query
def t3_drift_states_latched(spark, sf):
    cfg = replace(I.CONFIG.drift, mode="latched", threshold_method="fixed", critical_consecutive=2)
    rows = drift.evaluation_rows(I.run(spark, sf).distances, FEATURES).withColumn("adwin_detected", F.lit(False))
    out = drift.drift_states(rows, cfg)
    return rounded(out.select("u", "drift_score", "drift_warning_active", "drift_active", "drift_fixed_active"), 5)


@query
def t4_adwin_flags(spark, sf):
    flags = I.run(spark, sf).change_flags
    return rounded(flags.drop("stream_id"))


@query
def t5_threshold_path(spark, sf):
    rows = I.run(spark, sf).thresholds
    return rounded(rows.select("t", "proposal", "threshold", "changed", "bounds_limited", "step_limited"))


@query
def t5_threshold_path_chunked(spark, sf):
    rows = control.threshold_path(I.run(spark, sf).ticks, I.CONFIG.control, chunk=40)
    return rounded(rows.select("t", "proposal", "threshold", "changed", "bounds_limited", "step_limited"))


@query
def t5_tick_quantiles(spark, sf):
    return rounded(control.tick_quantiles(I.run(spark, sf).scored, I.CONFIG.control).select("t", "n_history", "proposal"))


@query
def t5_rate_feedback(spark, sf):
    run = I.run(spark, sf)
    ticks = control.tick_quantiles(run.scored, I.FEEDBACK).withColumns({"drift_active": F.lit(False), "frozen": F.lit(False)})
    path = control.threshold_path(ticks, I.FEEDBACK)
    return rounded(path.select("t", "proposal", "threshold", "step_limited", "feedback_blocked"))


@query
def t6_control_counters(spark, sf):
    return I.run(spark, sf).counters.drop("stream_id")


@query
def t7_audit(spark, sf):
    return rounded(I.run(spark, sf).audit.drop("stream_id", "ts_us"))


@query
def t8_lag_circuit(spark, sf):
    releases = I.controls(spark, sf).filter(F.col("action") == control.UNFREEZE).select("stream_id", "ts_us")
    openings = control.circuit_openings(I.lags(spark, sf), releases, I.CONFIG.control)
    return rounded(openings.select("event_id", "ts_us", "lag_s"))


@query
def t8_circuit_alerts(spark, sf):
    releases = I.controls(spark, sf).filter(F.col("action") == control.UNFREEZE).select("stream_id", "ts_us")
    rows = alerts.circuit_alerts(control.circuit_openings(I.lags(spark, sf), releases, I.CONFIG.control))
    return rounded(rows.select("alert_id", "ts_us", "entity_id", "severity", "reason", "processing_lag_seconds"))


@query
def t9_control_audit(spark, sf):
    return control.control_audit(I.controls(spark, sf)).drop("stream_id")


@query
def t9_refreshed_profiles(spark, sf):
    run = I.run(spark, sf)
    asked = I.controls(spark, sf).filter(F.col("action") == control.REFRESH)
    table = profile.refreshed_profiles(run.scored, run.profile, asked, I.CONFIG.drift, FEATURES)
    ends = (F.coalesce("to_u", F.lit(-1)).alias("to_u"), F.col("edges")[5].alias("mid_edge"))
    return rounded(table.select("profile_id", "feature", "from_u", *ends, "n", "mean", "std"), 5)


def _sharing(base: ScoringRun, run: ScoringRun, *names: str) -> ScoringRun:
    """``run`` with tables of a run over the same events and settings in place of its own."""
    for name in names:
        run.__dict__[name] = getattr(base, name)
    return run


DETECTOR = ("features", "model", "scored", "profile", "distances", "evaluations")


@query
def t9_controlled_run(spark, sf):
    """Thresholds of a run with freezes, releases and the lag circuit in force."""
    switches = I.controls(spark, sf).filter(F.col("action") != control.REFRESH)
    run = ScoringRun(I.events(spark, sf), I.CONFIG, switches, I.lags(spark, sf))
    run = _sharing(I.run(spark, sf), run, *DETECTOR)
    return rounded(run.thresholds.select("t", "threshold", "changed"))


@query
def t9_refreshed_distances(spark, sf):
    """Distances against the profile version in force at each evaluation."""
    run = ScoringRun(I.events(spark, sf), I.CONFIG, I.controls(spark, sf))
    run = _sharing(I.run(spark, sf), run, "model", "features", "scored")
    return rounded(run.distances.select("u", "profile_id", "feature", "n_cur", "psi", "ks", "mean_shift_z"), 5)


def _sweep_rows(spark, sf) -> DataFrame:
    """Request log as sweep input: scores and votes per evaluated request."""
    rows = logs.with_request_defaults(I.requests(spark, sf)).filter("drift_evaluated = 1")
    return rows.select("ts_us", F.col("request_id").alias("event_id"), "phase", "score", "threshold", "vote_ratio", "ground_truth_drift")


@query
def t10_replay(spark, sf):
    """Chunks of 100 positions, so that the state maps of many chunks are composed."""
    return sweep.replay_confusion(sweep.split_rows(_sweep_rows(spark, sf)), sweep.grid(), 100).withColumn("fold", F.col("fold").cast("long"))


@query
def t11_split(spark, sf):
    rows = sweep.split_rows(_sweep_rows(spark, sf))
    return rows.select("event_id", "phase", F.col("fold").cast("long").alias("fold"), "pos")


@query
def t11_cross_validation(spark, sf):
    replayed = stage(sweep.replay_confusion(sweep.split_rows(_sweep_rows(spark, sf)), sweep.grid()), "replayed")
    return rounded(sweep.cross_validated(replayed))


# --- models ------------------------------------------------------------------------------


@query
def m1_zscore_raw(spark, sf):
    return rounded(I.run(spark, sf).scored.select("event_id", "t", "raw_score"), 5)


@query
def m2_isolation_forest(spark, sf):
    run = I.run(spark, sf)
    warmup = I.CONFIG.model.warmup_events
    model = IsolationForestModel(replace(I.CONFIG.model, kind="isolation_forest"))
    warm = run.features.filter(F.col("idx") <= warmup).select("stream_id", "event_id", "idx", *FEATURES)
    fitted = model.fit(warm, FEATURES)
    rows = run.scored.select("stream_id", "event_id", "idx", *FEATURES)
    return rounded(fitted.transform(rows).select("event_id", "raw_score", "score"))


@query
def m3_scorer_lifecycle(spark, sf):
    rows = I.run(spark, sf).output
    return rounded(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("score").alias("score")), 3)


# --- composite jobs ----------------------------------------------------------------------


@query
def c1_scored_output(spark, sf):
    cols = ("event_id", "status", "score", "threshold", "is_anomaly", "drift_evaluated", "drift_active", "drift_warning_active", "drift_score", "vote_ratio")
    rows = I.run(spark, sf).output.select(*cols)
    return rounded(rows.na.fill(False, ["is_anomaly", "drift_evaluated", "drift_active", "drift_warning_active"]), 5)


@query
def c1_evaluations_with_adwin(spark, sf):
    cfg = replace(I.CONFIG, drift=replace(I.CONFIG.drift, adwin_enabled=True))
    base = I.run(spark, sf)
    run = _sharing(base, ScoringRun(base.events, cfg), "features", "model", "scored", "profile", "distances")
    return rounded(run.evaluations.select("u", "drift_score", "adwin_detected", "drift_warning_active", "drift_active"), 5)


@query
def c1_alerts(spark, sf):
    return rounded(I.run(spark, sf).alerts.select("event_id", "ts_us", "threshold", "severity", F.col("drift_state.drift_score").alias("drift_score")), 5)


@query
def c2_drift_report(spark, sf):
    return rounded(reports.psi_report(_psi_windows(spark, sf)), 4)


@query
def c3_run_evaluation(spark, sf):
    return rounded(reports.evaluate_run(I.requests(spark, sf))["detectors"], 3)


@query
def c3_run_phases(spark, sf):
    return rounded(reports.evaluate_run(I.requests(spark, sf))["phases"])


@query
def c3_run_labels(spark, sf):
    return reports.evaluate_run(I.requests(spark, sf))["labels"]


@query
def c3_run_errors(spark, sf):
    rows = reports.evaluate_run(I.requests(spark, sf))["errors"]
    return rounded(rows.select("request_id", "phase", "error_kind", "score", "vote_ratio", F.col("feature_scores")["amt"]["psi"].alias("psi")))


@query
def c3_run_summary(spark, sf):
    return rounded(reports.evaluate_run(I.requests(spark, sf))["summary"], 4)


@query
def c3_run_evaluation_streams(spark, sf):
    """Three streams of requests, by endpoint, evaluated at once."""
    rows = I.requests(spark, sf).withColumn("stream_id", F.col("endpoint"))
    found = reports.evaluate_run(rows, STREAMS)["detectors"]
    return rounded(found.select("stream_id", "detector", "points", "tp", "fp", "fn", "tn", "false_alert_reduction", "segments_total", "segments_detected"), 3)


@query
def c3_scoring_run_evaluation(spark, sf):
    rows = reports.requests_of(I.run(spark, sf)).withColumn("feature_scores_json", F.lit("")).withColumn("latency_ms", F.lit(0.0))
    return rounded(reports.evaluate_run(rows)["detectors"], 3)


@query
def c4_compare_passes(spark, sf):
    tuned = I.run(spark, sf)
    cfg = replace(I.CONFIG, control=replace(I.CONFIG.control, enabled=False))
    baseline = _sharing(tuned, ScoringRun(I.events(spark, sf), cfg), *DETECTOR)
    row = reports.compare_passes(
        reports.pass_summary(baseline, "baseline"), reports.pass_summary(tuned, "tuned"), tuned.counters, I.CONFIG.control.target_rate
    )
    return rounded(row.drop("stream_id", "hard_limit_message", "target_message"))


@query
def c5_replay_confusion(spark, sf):
    return rounded(reports.replay_confusion(I.run(spark, sf)))


@query
def c5_replay_summary(spark, sf):
    return rounded(reports.replay_summary(I.run(spark, sf)).drop("stream_id"), 3)


@query
def c6_threshold_sweep(spark, sf):
    """Also the top-5 limit."""
    rows = sweep.sweep(_sweep_rows(spark, sf), sweep.grid())
    cols = ("place", "param_id", "critical_enter", "critical_vote", "critical_consecutive", "objective", "precision", "recall", "f1", "holdout_precision", "holdout_recall")
    return rounded(rows.select(*cols))
