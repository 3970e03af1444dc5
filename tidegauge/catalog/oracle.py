"""SQL equivalents of the registered queries, composed from named common table expressions."""

from __future__ import annotations

import math
import re

from tidegauge.catalog import inputs as I
from tidegauge.config import FEATURES, PHASE_LABELS, PHASES
from tidegauge.operators import control, inject, ops
from tidegauge.sources.events import CHANNELS, COUNTRIES, DEVICE_TYPES

W_US = I.WINDOW_SECONDS * I.US
NAMES = (*FEATURES, "score")
DC = I.CONFIG.drift
CC = I.CONFIG.control


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


def _guard(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE greatest(least({c}, 1e6), -1e6) END)"


def _uniform(salt: str) -> str:
    return f"(('0x' || substr(md5(event_id || '|42-{salt}'), 1, 8))::BIGINT / 4294967296.0)"


def _choice(u: str, values, weights) -> str:
    total = float(sum(weights))
    cases = [f"WHEN {u} < {sum(weights[: i + 1]) / total!r} THEN '{values[i]}'" for i in range(len(values) - 1)]
    return f"(CASE {' '.join(cases)} ELSE '{values[-1]}' END)"


def _bin(value: str, edges: str) -> str:
    return (
        f"(CASE WHEN {value} IS NULL OR isnan({value}) OR {value} < {edges}[1] OR {value} > {edges}[11] THEN 0 "
        f"ELSE least(len(list_filter({edges}, lambda e: e <= {value})), 10) END)"
    )


def _rates(tp="tp", fp="fp", fn="fn") -> str:
    p = f"(CASE WHEN {tp}+{fp} > 0 THEN {tp}::DOUBLE/({tp}+{fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp}+{fn} > 0 THEN {tp}::DOUBLE/({tp}+{fn}) ELSE 0.0 END)"
    return (
        f"round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round(CASE WHEN {p}+{r} > 0 THEN 2*{p}*{r}/({p}+{r}) ELSE 0.0 END, 6) AS f1, "
        f"round(CASE WHEN {tp}+{fp} > 0 THEN {fp}::DOUBLE/({tp}+{fp}) ELSE 0.0 END, 6) AS false_alert_rate"
    )


def _confusion(truth: str, pred: str) -> str:
    return (
        f"count(*) FILTER ({truth} AND {pred}) AS tp, count(*) FILTER (NOT {truth} AND {pred}) AS fp, "
        f"count(*) FILTER ({truth} AND NOT {pred}) AS fn, count(*) FILTER (NOT {truth} AND NOT {pred}) AS tn"
    )


_FRAME = f"(PARTITION BY entity_id ORDER BY ts_us RANGE BETWEEN {W_US} PRECEDING AND 1 PRECEDING)"
_SHARE = f"((ts_us - {I.RUN_START}) / {float(I.RUN_DAYS * 86_400 * I.US)!r})"
_PHASE = f"(CASE WHEN {_SHARE} < 0.35 THEN 'normal' WHEN {_SHARE} < 0.60 THEN 'gradual_drift' WHEN {_SHARE} < 0.80 THEN 'sudden_drift' ELSE 'noisy_non_drift' END)"
_LABEL = f"(CASE WHEN {_SHARE} < 0.35 THEN 0 WHEN {_SHARE} < 0.80 THEN 1 ELSE 0 END)"
_NORM = "sqrt(" + " + ".join(f"{_guard(f)}*{_guard(f)}" for f in FEATURES) + ")"
_DAY = "date_diff('day', DATE '1970-01-01', l_shipdate::DATE)"
_IN1, _IN2, _IN3 = (f"(day BETWEEN {a} AND {b})" for a, b in ((9700, 9850), (10300, 10420), (10900, 11000)))
_PSI_TERM = "(c - r) * ln(c / r)"


def _capped(n: int) -> str:
    """Window features with at most ``n`` - 1 prior events, by self-join on ranks."""
    return f"""
 SELECT a.event_id, count(b.rn)::DOUBLE AS cnt_5m, coalesce(sum(b.amount), 0.0) AS amt_sum_5m,
  coalesce(avg(b.amount), 0.0) AS amt_mean_5m, coalesce(stddev_pop(b.amount), 0.0) AS amt_std_5m,
  count(DISTINCT b.merchant_id)::DOUBLE AS uniq_merchant_5m, count(DISTINCT b.country)::DOUBLE AS uniq_country_5m,
  0.0 AS time_since_last,
  CASE WHEN count(b.rn) > 0 THEN count(b.rn) / greatest(1.0, (any_value(a.ts_us) - min(b.ts_us)) / 1e6) * 60.0 ELSE 0.0 END AS rate_per_min
 FROM ranked a LEFT JOIN ranked b ON a.entity_id = b.entity_id AND b.rn BETWEEN a.rn - {n - 1} AND a.rn - 1 AND b.ts_us >= a.ts_us - {W_US}
 GROUP BY a.event_id"""


CTES: dict[str, str] = {
    "base": f"""
 SELECT 'main' AS stream_id, CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS entity_id,
  value AS amount, CAST(k AS VARCHAR) AS merchant_id, event_type AS merchant_category, {_list(COUNTRIES)}[k % 5 + 1] AS country,
  {_list(CHANNELS)}[k % 3 + 1] AS channel, {_list(DEVICE_TYPES)}[k % 4 + 1] AS device_type, k,
  epoch_us(ts) BETWEEN {I.DRIFT_FROM} AND {I.DRIFT_TO} AS inside
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "ev": """
 SELECT * REPLACE (CASE WHEN inside THEN amount * 2.0 ELSE amount END AS amount),
  CASE WHEN inside THEN 'mean_shift_amount' END AS drift_tag FROM base""",
    "feat": f"""
 SELECT *, count(*) OVER w::DOUBLE AS cnt_5m, coalesce(sum(amount) OVER w, 0.0) AS amt_sum_5m, coalesce(avg(amount) OVER w, 0.0) AS amt_mean_5m,
  coalesce(stddev_pop(amount) OVER w, 0.0) AS amt_std_5m, (count(DISTINCT merchant_id) OVER w)::DOUBLE AS uniq_merchant_5m,
  (count(DISTINCT country) OVER w)::DOUBLE AS uniq_country_5m, 0.0 AS time_since_last,
  CASE WHEN count(*) OVER w > 0 THEN count(*) OVER w / greatest(1.0, (ts_us - min(ts_us) OVER w) / 1e6) * 60.0 ELSE 0.0 END AS rate_per_min,
  row_number() OVER (ORDER BY ts_us, event_id) AS idx
 FROM ev WINDOW w AS {_FRAME}""",
    "norms": f"SELECT *, {_NORM} AS norm FROM feat",
    "zmodel": "SELECT count(*) AS n, avg(norm) AS norm_mean, sqrt(greatest(1e-9, (1 + var_pop(norm) * count(*)) / greatest(1, count(*) - 1))) AS norm_scale FROM norms WHERE idx <= 1500",
    "raws": "SELECT norms.*, (norm - norm_mean) / norm_scale AS raw_score FROM norms, zmodel",
    "nmodel": "SELECT avg(raw_score) AS raw_mean, CASE WHEN stddev_pop(raw_score) = 0 THEN 1.0 ELSE stddev_pop(raw_score) END AS raw_std FROM raws WHERE idx <= 1500",
    "scored": "SELECT raws.*, idx - 1500 AS t, 1.0 / (1.0 + exp(-(raw_score - raw_mean) / (raw_std + 1e-9))) AS score FROM raws, nmodel WHERE idx > 1500",
    "longs": "SELECT t, i.feature AS feature, i.value AS value FROM (SELECT t, unnest([" + ", ".join(f"{{'feature': '{f}', 'value': {f}}}" for f in NAMES) + "]) AS i FROM scored)",
    "prof": f"""
 SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) + 1e-9 AS std,
  list_concat(list_concat([min(value) - 1e-9], quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])), [max(value) + 1e-9]) AS edges
 FROM longs WHERE t <= {DC.reference_events} GROUP BY feature""",
    "bins10": "SELECT range AS bin FROM range(1, 11)",
    "refshare": f"""
 SELECT p.feature, b.bin, least(greatest(count(l.value) / {float(DC.reference_events)!r}, 1e-6), 1.0) AS r
 FROM prof p CROSS JOIN bins10 b LEFT JOIN longs l ON l.feature = p.feature AND l.t <= {DC.reference_events} AND {_bin('l.value', 'p.edges')} = b.bin
 GROUP BY p.feature, b.bin""",
    "evalticks": f"""
 SELECT u, least(u, {DC.window_size}) AS n_cur FROM (SELECT unnest(range({DC.interval}, (SELECT max(t) FROM scored) - {DC.reference_events} + 1, {DC.interval})) AS u)
 WHERE least(u, {DC.window_size}) >= {DC.min_samples}""",
    "curbinned": f"""
 SELECT e.u, l.feature, {_bin('l.value', 'p.edges')} AS bin, count(*) AS c, sum(l.value) AS s
 FROM evalticks e JOIN longs l ON l.t - {DC.reference_events} > e.u - {DC.window_size} AND l.t - {DC.reference_events} <= e.u AND l.t > {DC.reference_events}
 JOIN prof p ON p.feature = l.feature GROUP BY ALL""",
    "curtotals": "SELECT u, feature, sum(c) FILTER (bin > 0) AS inside, sum(c) AS n_cur, sum(s) AS s FROM curbinned GROUP BY u, feature",
    "curshare": """
 SELECT t.u, t.feature, r.bin, r.r, coalesce(c.c, 0)::DOUBLE / greatest(1, coalesce(t.inside, 0)) AS raw
 FROM curtotals t JOIN refshare r ON r.feature = t.feature LEFT JOIN curbinned c ON c.u = t.u AND c.feature = t.feature AND c.bin = r.bin""",
    "cumshare": """
 SELECT *, abs(sum(r) OVER w - sum(raw) OVER w) AS gap FROM curshare WINDOW w AS (PARTITION BY u, feature ORDER BY bin)""",
    "dist": """
 SELECT t.u, t.feature, t.n_cur::BIGINT AS n_cur, d.psi, d.ks, sqrt(-0.5 * ln(0.0005)) * sqrt((p.n + t.n_cur) / (p.n * t.n_cur)::DOUBLE) AS ks_critical,
  abs(t.s / t.n_cur - p.mean) / greatest(1e-9, p.std) AS mean_shift_z
 FROM curtotals t JOIN prof p USING (feature) JOIN (
  SELECT u, feature, sum((least(greatest(raw, 1e-6), 1.0) - r) * ln(least(greatest(raw, 1e-6), 1.0) / r)) AS psi, max(gap) AS ks
  FROM cumshare GROUP BY u, feature) d USING (u, feature)""",
    "normed": f"""
 SELECT u, feature, least(ln(1 + greatest(0.0, psi / 0.25)), 3.0) AS psi_norm, least(ln(1 + greatest(0.0, ks / greatest(1e-9, ks_critical))), 3.0) AS ks_norm,
  least(ln(1 + greatest(0.0, mean_shift_z / 2.5)), 3.0) AS shift_norm FROM dist""",
    "fused": """
 SELECT u, 0.5 * avg(psi_norm) FILTER (feature <> 'score') AS psi_component, 0.3 * avg(ks_norm) FILTER (feature <> 'score') AS ks_component,
  0.2 * (0.5 * avg(psi_norm) FILTER (feature = 'score') + 0.5 * avg(ks_norm) FILTER (feature = 'score')) AS prediction_component,
  count(*) FILTER (feature <> 'score' AND 0.55 * psi_norm + 0.30 * ks_norm + 0.15 * shift_norm >= 0.65) / 8.0 AS vote_ratio,
  avg(0.55 * psi_norm + 0.30 * ks_norm + 0.15 * shift_norm) FILTER (feature <> 'score') AS mean_fusion
 FROM normed GROUP BY u""",
    "judged99": "SELECT *, score >= 0.99 AS is_anomaly, drift_tag IS NOT NULL AND drift_tag <> '' AS drift FROM scored",
    "al": f"""
 SELECT substr(sha256('alert|' || event_id || '|' || ts_us || '|' || printf('%.9f', score) || '|'), 1, 24) AS alert_id, *,
  CASE WHEN score >= 0.99 THEN 'high' WHEN score >= 0.95 THEN 'medium' ELSE 'low' END AS severity
 FROM scored WHERE score >= 0.99""",
    "req": f"""
 SELECT ts_us / 1e6 AS timestamp, event_id AS request_id, ['/score', '/predict', '/detect_drift'][k % 3 + 1] AS endpoint,
  CASE k WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS status_code, amount / 8.0 AS latency_ms, {_PHASE} AS phase,
  CASE WHEN k = 50 THEN 1 - {_LABEL} ELSE {_LABEL} END AS ground_truth_drift,
  CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS drift_evaluated,
  CASE WHEN amount > 70.0 AND k % 2 = 0 THEN 1 ELSE 0 END AS critical_alert, CASE WHEN amount > 90.0 THEN 1 ELSE 0 END AS fixed_alert,
  k / 100.0 AS vote_ratio, amount / 100.0 AS score, 0.8 AS threshold, k, ts_us, amount
 FROM ev""",
    "okreq": "SELECT * FROM req WHERE status_code >= 200 AND status_code < 400",
    "runreq": "SELECT *, row_number() OVER (ORDER BY ts_us, request_id) AS idx FROM okreq WHERE drift_evaluated = 1",
    "numreq": "SELECT *, row_number() OVER (ORDER BY ts_us, request_id) AS idx FROM req",
    "copies": """
 SELECT *, CASE WHEN k % 2 = 0 THEN 'stream' ELSE 'api' END AS source FROM ev
 UNION ALL SELECT * REPLACE (ts_us + 5000000 AS ts_us, amount + 1.0 AS amount), CASE WHEN k % 2 = 0 THEN 'stream' ELSE 'api' END FROM ev WHERE k % 3 = 0
 UNION ALL SELECT *, CASE WHEN k % 2 = 0 THEN 'stream' ELSE 'api' END FROM ev WHERE k % 5 = 0""",
    "odd": """
 SELECT event_id, CASE WHEN k = 0 THEN 'nan'::DOUBLE WHEN k = 1 THEN 'inf'::DOUBLE WHEN k = 2 THEN '-inf'::DOUBLE WHEN k = 3 THEN NULL
  WHEN k = 4 THEN amount * 1e9 ELSE amount END AS x FROM ev""",
    "ref": f"SELECT merchant_category AS feature, amount AS value FROM ev WHERE ts_us < {I.MIDPOINT}",
    "cur": f"SELECT merchant_category AS feature, amount AS value FROM ev WHERE ts_us >= {I.MIDPOINT}",
    "refq": "SELECT feature, quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM ref GROUP BY feature",
    "padded": "SELECT feature, list_concat(list_concat([q[1] - 1e-9], q[2:10]), [q[11] + 1e-9]) AS edges, n, mean, std FROM refq",
    "lagrows": "SELECT event_id, ts_us, k, greatest(0.0, (ts_us / 1e6 + k / 16.0 - 0.25) - coalesce(CASE WHEN k % 2 = 0 THEN ts_us / 1e6 + k / 40.0 END, ts_us / 1e6)) AS lag_s FROM ev",
    "acts": """
 SELECT ts_us, CASE k WHEN 7 THEN 'freeze_adaptation' WHEN 13 THEN 'unfreeze_adaptation' WHEN 29 THEN 'refresh_reference' END AS action,
  CASE WHEN CAST(entity_id AS BIGINT) % 2 = 0 THEN 'op_' || entity_id END AS actor, CASE WHEN CAST(entity_id AS BIGINT) % 3 = 0 THEN 'review' END AS reason
 FROM ev WHERE k IN (7, 13, 29)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_us, event_id) AS rn FROM ev",
    "ftab0": f"""
 SELECT (l_orderkey * 8 + l_linenumber) AS row_id, l_partkey, l_suppkey, l_returnflag, {_DAY} AS day, {_DAY} * 86400000000 AS ts_us, l_quantity AS f1, l_extendedprice AS f2,
  l_discount AS f3, l_tax * 10.0 AS p FROM lineitem""",
    "ftab": f"""
 SELECT row_id, l_partkey, l_suppkey, l_returnflag, ts_us, CASE WHEN {_IN1} THEN f1 + 15.0 WHEN {_IN3} THEN f1 - 12.0 ELSE f1 END AS feature_1,
  CASE WHEN {_IN2} THEN f2 * 1.35 WHEN {_IN3} THEN f2 + 9000.0 ELSE f2 END AS feature_2, CASE WHEN {_IN2} THEN f3 - 0.03 ELSE f3 END AS feature_3,
  CASE WHEN {_IN1} THEN least(greatest(p + 0.25, 0.0), 1.0) WHEN {_IN3} THEN least(greatest(p - 0.2, 0.0), 1.0) ELSE p END AS pred_score,
  CASE WHEN {_IN1} OR {_IN2} OR {_IN3} THEN 1 ELSE 0 END AS drift_label FROM ftab0""",
    "ftabx": "SELECT *, row_number() OVER (ORDER BY ts_us, row_id, l_partkey, l_suppkey, feature_1, feature_2, feature_3, pred_score) AS idx FROM ftab",
}


def _window_psi(size: int, step: int, prefix: str) -> dict[str, str]:
    """CTEs of the windowed PSI over the feature table with 5000 reference rows."""
    cols = ("feature_1", "feature_2", "feature_3", "pred_score")
    unnest = "unnest([" + ", ".join(f"{{'feature': '{c}', 'value': {c}}}" for c in cols) + "])"
    return {
        f"{prefix}wins": f"SELECT w AS window_id, 5000 + w * {step} AS start_idx FROM (SELECT unnest(range(0, ((SELECT max(idx) FROM ftabx) - 5000 - {size}) // {step} + 1)) AS w)",
        f"{prefix}ref": f"SELECT i.feature AS feature, i.value AS value FROM (SELECT {unnest} AS i FROM ftabx WHERE idx <= 5000)",
        f"{prefix}edges": f"SELECT feature, list_concat(list_concat(['-inf'::DOUBLE], quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])), ['inf'::DOUBLE]) AS edges FROM {prefix}ref GROUP BY feature",
        f"{prefix}share": f"SELECT e.feature, b.bin, CASE WHEN count(r.value) = 0 THEN 1e-6 ELSE count(r.value) / 5000.0 END AS r FROM {prefix}edges e CROSS JOIN bins10 b LEFT JOIN {prefix}ref r ON r.feature = e.feature AND {_bin('r.value', 'e.edges')} = b.bin GROUP BY ALL",
        f"{prefix}long": f"SELECT idx, i.feature AS feature, i.value AS value FROM (SELECT idx, {unnest} AS i FROM ftabx WHERE idx > 5000)",
        f"{prefix}lbin": f"SELECT l.idx, l.feature, {_bin('l.value', 'e.edges')} AS bin FROM {prefix}long l JOIN {prefix}edges e USING (feature)",
        f"{prefix}cur": f"SELECT w.window_id, l.feature, l.bin, count(*) AS c FROM {prefix}wins w JOIN {prefix}lbin l ON l.idx > w.start_idx AND l.idx <= w.start_idx + {size} GROUP BY ALL",
        f"{prefix}psi": f"""SELECT window_id, feature, sum({_PSI_TERM}) AS psi FROM (SELECT w.window_id, s.feature, s.r, CASE WHEN c.c IS NULL THEN 1e-6 ELSE c.c / {float(size)!r} END AS c
 FROM {prefix}wins w CROSS JOIN {prefix}share s LEFT JOIN {prefix}cur c ON c.window_id = w.window_id AND c.feature = s.feature AND c.bin = s.bin) GROUP BY ALL""",
        f"{prefix}rows": f"""SELECT w.window_id, w.start_idx, w.start_idx + {size} AS end_idx, min_by(f.ts_us, f.idx) AS start_us, max_by(f.ts_us, f.idx) AS end_us,
 CASE WHEN avg(f.drift_label) >= 0.5 THEN 1 ELSE 0 END AS true_drift, any_value(p.max_psi) AS max_psi
 FROM {prefix}wins w JOIN ftabx f ON f.idx > w.start_idx AND f.idx <= w.start_idx + {size} JOIN (SELECT window_id, max(psi) AS max_psi FROM {prefix}psi GROUP BY 1) p USING (window_id) GROUP BY w.window_id, w.start_idx""",
    }


CTES.update(_window_psi(1000, 500, "a_"))
CTES.update(_window_psi(500, 500, "b_"))
CTES["b_hist"] = """
 SELECT *, quantile_cont(max_psi, 0.95) OVER (ORDER BY window_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS q FROM b_rows"""
CTES["b_alerts"] = """
 SELECT *, CASE WHEN max_psi >= 0.2 THEN 1 ELSE 0 END AS alert_fixed, CASE WHEN max_psi >= adaptive_threshold THEN 1 ELSE 0 END AS alert_adaptive
 FROM (SELECT *, CASE WHEN window_id >= 20 THEN greatest(q, 0.2 * 0.7) ELSE 0.2 END AS adaptive_threshold FROM b_hist)"""


def _segments(source: str, pos: str, ts: str, truth: str, pred: str) -> str:
    return f"""
 SELECT min({pos}) AS first_pos, max({pos}) AS last_pos, min({ts}) AS start_us, min({pos}) FILTER ({pred} = 1) AS detected_pos,
  min({ts}) FILTER ({pred} = 1) AS detected_us, count(*) FILTER ({pred} = 1) > 0 AS detected,
  CASE WHEN count(*) FILTER ({pred} = 1) > 0 THEN greatest(0.0, (min({ts}) FILTER ({pred} = 1) - min({ts})) / 1e6) END AS latency_s,
  min({pos}) FILTER ({pred} = 1) - min({pos}) AS latency_windows
 FROM (SELECT *, {pos} - row_number() OVER (ORDER BY {pos}) AS grp FROM {source} WHERE {truth} = 1) GROUP BY grp"""


def _found(cte: str, digits: int = 3) -> str:
    return (
        f"(SELECT count(*) FROM {cte}) AS segments_total, (SELECT count(*) FILTER (detected) FROM {cte}) AS segments_detected, "
        f"round(coalesce((SELECT avg(latency_s) FROM {cte} WHERE detected), 0.0), {digits}) AS avg_latency_s"
    )


CTES["reqseg"] = _segments("numreq", "idx", "ts_us", "ground_truth_drift", "critical_alert")
CTES["runseg_c"] = _segments("runreq", "idx", "ts_us", "ground_truth_drift", "critical_alert")
CTES["runseg_f"] = _segments("runreq", "idx", "ts_us", "ground_truth_drift", "fixed_alert")
CTES["bseg_f"] = _segments("b_alerts", "window_id", "start_us", "true_drift", "alert_fixed")
CTES["bseg_a"] = _segments("b_alerts", "window_id", "start_us", "true_drift", "alert_adaptive")

# The windows of each of three streams alone.
for _s in "anr":
    CTES[f"ftab_{_s}"] = CTES["ftabx"] + f" WHERE l_returnflag = '{_s.upper()}'"
    CTES.update({k: v.replace("ftabx", f"ftab_{_s}") for k, v in _window_psi(500, 500, f"{_s}3_").items()})
    CTES[f"{_s}3_hist"] = CTES["b_hist"].replace("b_rows", f"{_s}3_rows")
    CTES[f"{_s}3_alerts"] = CTES["b_alerts"].replace("b_hist", f"{_s}3_hist")
    CTES[f"{_s}3seg_f"] = _segments(f"{_s}3_alerts", "window_id", "start_us", "true_drift", "alert_fixed")
    CTES[f"{_s}3seg_a"] = _segments(f"{_s}3_alerts", "window_id", "start_us", "true_drift", "alert_adaptive")
for _e in ("score", "predict", "detect_drift"):
    CTES[f"req_{_e}"] = f"SELECT *, row_number() OVER (ORDER BY ts_us, request_id) AS idx FROM req WHERE endpoint = '/{_e}'"
    CTES[f"reqseg_{_e}"] = _segments(f"req_{_e}", "idx", "ts_us", "ground_truth_drift", "critical_alert")


def compose(sql: str) -> str:
    """Prefix a statement with the expressions it needs, in order of use."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = []
    for name in needed:
        # A body that refers to itself is a recursive expression.
        body = CTES[name]
        kind = "" if "@self" in body else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({body.replace('@self', name)})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql


RAW: dict[str, str] = {}
_FEAT_OUT = "event_id, " + ", ".join(
    f"round({f}{' + 1e-8' if f in ('amt_mean_5m', 'rate_per_min', 'amt_std_5m') else ''}, 6) AS {f}" for f in FEATURES
)

RAW["s1_jsonl_replay"] = "SELECT event_id, ts_us, entity_id, round(amount, 6) AS amount, country, device_type, drift_tag FROM ev"
RAW["s2_parse_broker_values"] = """
SELECT 'ok' AS outcome, CASE WHEN k = 24 THEN 'unknown' ELSE device_type END AS detail, count(*) AS n, round(sum(amount), 2) AS amount FROM ev WHERE k NOT BETWEEN 20 AND 23 GROUP BY ALL
UNION ALL SELECT 'dead_letter', CASE k WHEN 20 THEN 'malformed' WHEN 21 THEN 'amount_negative' WHEN 22 THEN 'channel_unknown' ELSE 'merchant_category_missing' END, count(*), 0.0 FROM ev WHERE k BETWEEN 20 AND 23 GROUP BY k"""
RAW["s4_validate_events"] = """
SELECT CASE WHEN why IS NULL THEN 'valid' ELSE 'rejected' END AS outcome, coalesce(why, dev) AS detail, count(*) AS n FROM (
 SELECT CASE WHEN k % 7 = 0 THEN 'unknown' WHEN k % 17 = 0 THEN 'watch' ELSE device_type END AS dev,
  CASE WHEN k % 13 = 0 THEN 'country_missing' WHEN k % 10 = 0 AND amount > 0 THEN 'amount_negative' WHEN k % 11 = 0 THEN 'channel_unknown'
   WHEN k % 17 = 0 AND k % 7 <> 0 THEN 'device_type_unknown' END AS why FROM ev) GROUP BY ALL"""
RAW["s5_label_integrity"] = """
SELECT 'complete' AS replay, count(*) FILTER (k <> 5) AS lines_total, TRUE AS drift_tag_present_all FROM ev
UNION ALL SELECT 'mixed', count(*), bool_and(k <> 5) FROM ev"""
RAW["s6_feature_csv"] = "SELECT feature, drift_label::BIGINT AS drift_label, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT drift_label, unnest(['feature_1','feature_2','feature_3']) AS feature, unnest([feature_1, feature_2, feature_3]) AS value FROM ftab) GROUP BY ALL"
RAW["s7_request_log"] = """
SELECT endpoint, status_code::BIGINT AS status_code, count(*) AS n, round(sum(printf('%.4f', latency_ms)::DOUBLE), 4) AS latency, round(min(timestamp), 4) AS first, sum(drift_evaluated)::BIGINT AS evaluated,
 count(*) FILTER (k % 10 > 1) AS with_scores FROM req GROUP BY ALL"""
RAW["s7_resource_log"] = f"SELECT count(*) AS n, round(min(ts_us / 1e6), 4) AS first, round(sum(CASE WHEN k % 4 = 0 THEN k / 2.0 ELSE 0.0 END), 4) AS percent, round(max(CASE WHEN k = 3 THEN 0.0 ELSE (ts_us - {I.RUN_START}) / 1e8 + k END), 4) AS cpu FROM ev"
RAW["s8_scrape"] = "SELECT CASE k % 6 WHEN 2 THEN 'events_scored_total' ELSE 'current_threshold' END AS metric, count(*) AS n, round(sum(amount), 2) AS total FROM ev WHERE k % 6 IN (2, 3) GROUP BY 1"
RAW["s9_alert_sink"] = "SELECT alert_id, ts_us, event_id, severity FROM al"
RAW["s10_labelled_stream"] = f"SELECT {_PHASE} AS phase, {_LABEL}::BIGINT AS ground_truth_drift, CASE WHEN {_LABEL} = 1 THEN {_PHASE} END AS drift_tag, count(*) AS n, round(sum(amount), 2) AS amount, round(sum(amount), 2) AS amount_flat FROM ev GROUP BY ALL"
RAW["s11_fixed_precision"] = "SELECT request_id, printf('%.6f', timestamp) AS timestamp, printf('%.4f', latency_ms) AS latency_ms, printf('%.6f', vote_ratio::DOUBLE) AS vote_ratio, printf('%.6f', score) AS score FROM req"
RAW["s12_summary_sink"] = "SELECT count(*) AS requests_total, count(*) FILTER (status_code >= 200 AND status_code < 400) AS requests_ok, round(quantile_cont(latency_ms, 0.95) FILTER (status_code >= 200 AND status_code < 400), 6) AS latency_p95_ms FROM req"

RAW["p1_stable_id"] = "SELECT event_id, substr(sha256('alert|' || event_id || '|' || ts_us || '|'), 1, 24) AS sid FROM ev"
RAW["p2_vector_guard"] = f"SELECT event_id, round({_guard('x')}, 6) AS guarded FROM odd"
RAW["p3_normalized_scores"] = "SELECT event_id, round(score, 6) AS score FROM scored"
RAW["p4_severity"] = """SELECT event_id, CASE WHEN score >= least(0.99, threshold + 0.10) THEN 'high' WHEN score >= least(0.95, threshold + 0.05) THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT event_id, amount / 200.0 AS score, k / 100.0::DOUBLE AS threshold FROM ev)"""
RAW["p5_hash_sample"] = "SELECT event_id, ('0x' || substr(sha256('threshold-log-sample|' || event_id || '|'), 1, 8))::BIGINT / 4294967295.0 < 0.1 AS tenth, TRUE AS whole, FALSE AS none FROM ev"
RAW["p6_alerts"] = "SELECT alert_id, event_id, entity_id, ts_us, round(score, 6) AS score, 0.99::DOUBLE AS threshold, severity, 'score>=threshold' AS reason, merchant_category AS category, country, channel FROM al"
_starts = [sum(p[1] for p in PHASES[:i]) for i in range(len(PHASES))]
RAW["p7_phase_labels"] = "SELECT event_id, CASE " + " ".join(
    f"WHEN e < {s + p[1]} THEN '{p[0]}'" for s, p in zip(_starts[:-1], PHASES[:-1])
) + f" ELSE '{PHASES[-1][0]}' END AS phase, (CASE " + " ".join(
    f"WHEN e < {s + p[1]} THEN {p[2]}" for s, p in zip(_starts[:-1], PHASES[:-1])
) + f" ELSE {PHASES[-1][2]} END)::BIGINT AS ground_truth_drift, round(CASE " + " ".join(
    f"WHEN e < {s + p[1]} THEN (e - {s}) / {float(p[1])}" for s, p in zip(_starts, PHASES)
) + f" ELSE 1.0 END, 6) AS progress FROM (SELECT event_id, {_SHARE} * 660.0 AS e FROM ev)"
RAW["p7_phase_by_share"] = f"SELECT event_id, {_PHASE} AS phase, {_LABEL}::BIGINT AS label FROM ev"
RAW["p8_label_rules"] = "SELECT event_id, tag IS NOT NULL AS present, tag IS NOT NULL AND tag <> '' AS truthy FROM (SELECT event_id, CASE WHEN k % 9 = 0 THEN '' ELSE drift_tag END AS tag FROM ev)"
_PROG = f"((ts_us - {I.DRIFT_FROM}) / {float(I.DRIFT_TO - I.DRIFT_FROM)!r})"


def _inject(pattern: str, amount="amount", category="merchant_category", country="country", tagged=True) -> None:
    tag = f"'{pattern}'" if tagged else "NULL"
    RAW[f"p9_inject_{pattern}"] = f"""SELECT event_id, round(CASE WHEN inside THEN {amount} ELSE amount END, 6) AS amount, CASE WHEN inside THEN {category} ELSE merchant_category END AS merchant_category,
 CASE WHEN inside THEN {country} ELSE country END AS country, CASE WHEN inside THEN {tag} END::VARCHAR AS drift_tag FROM base"""


_inject("mean_shift_amount", "amount * 2.0")
_inject("bursty_entities", f"CASE WHEN {_uniform('burst')} < 0.03 THEN amount * 12.0 ELSE amount END")
_inject("new_category", category=_choice(_uniform("category"), [*inject.CATEGORIES, *inject.NEW_CATEGORIES], inject.NEW_CATEGORY_WEIGHTS))
_inject("gradual", f"amount * (1.0 + 1.4 * {_PROG})", f"CASE WHEN {_uniform('travel')} < 0.15 + 0.25 * {_PROG} THEN 'travel' ELSE merchant_category END")
_inject("sudden", f"amount * (CASE WHEN {_uniform('strength')} < 0.7 THEN 2.5 ELSE 1.25 END)",
        _choice(_uniform("category"), inject.SUDDEN_CATEGORIES, inject.SUDDEN_CATEGORY_WEIGHTS),
        _choice(_uniform("country"), inject.SUDDEN_COUNTRIES, inject.SUDDEN_COUNTRY_WEIGHTS))
_inject("noisy", f"amount * (0.55 + 0.9 * {_uniform('noise')}) * (CASE WHEN {_uniform('spike')} < 0.01 THEN 5.0 ELSE 1.0 END)", tagged=False)
RAW["p9_shift_columns"] = """SELECT drift_label::BIGINT AS drift_label, count(*) AS n, round(avg(feature_1), 4) AS feature_1, round(avg(feature_2), 4) AS feature_2, round(avg(feature_3), 4) AS feature_3,
 round(avg(pred_score), 4) AS pred_score, round(min(pred_score), 4) AS low, round(max(pred_score), 4) AS high FROM ftab GROUP BY 1"""
RAW["p10_ks_critical"] = """SELECT event_id, round(CASE WHEN n < 2 OR m < 2 THEN 'inf'::DOUBLE ELSE sqrt(-0.5 * ln(0.0005)) * sqrt((n + m)::DOUBLE / (n * m)) END, 6) AS critical
FROM (SELECT event_id, k AS n, CAST(entity_id AS BIGINT) + 1 AS m FROM ev)"""
RAW["p11_enabled_features"] = "SELECT event_id, round(cnt_5m, 6) AS cnt_5m, round(rate_per_min + 1e-8, 6) AS rate_per_min FROM feat"
RAW["p12_processing_lag"] = "SELECT event_id, round(lag_s, 6) AS lag_s FROM lagrows"
RAW["p13_feature_scores"] = "SELECT request_id, CASE WHEN k % 10 > 1 THEN 1 ELSE 0 END::BIGINT AS features, CASE WHEN k % 10 > 1 THEN round(k / 100.0::DOUBLE, 2) END AS psi, CASE WHEN k % 10 > 1 THEN round(k / 1000.0::DOUBLE, 3) END AS ks FROM req"
RAW["p14_damped_ratio"] = "SELECT event_id, round(least(ln(1 + greatest(0.0, amount / 10.0 - 1.0)), 3.0), 6) AS norm FROM ev"
RAW["p15_finite"] = "SELECT event_id, x IS NOT NULL AND isfinite(x) AS finite FROM odd"

RAW["d1_first_per_id"] = "SELECT event_id, ts_us, round(amount, 6) AS amount, source FROM copies QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts_us) = 1"
RAW["d2_duplicate_counts"] = "SELECT source, (count(*) - count(DISTINCT event_id))::BIGINT AS duplicates FROM copies GROUP BY source"
RAW["d3_alert_dedupe"] = "SELECT alert_id, ts_us, severity FROM al"
RAW["d4_evaluated_rows"] = "SELECT endpoint, drift_evaluated::BIGINT AS drift_evaluated, count(*) AS n FROM okreq WHERE drift_evaluated = 1 GROUP BY ALL"
RAW["d4_evaluated_fallback"] = "SELECT endpoint, count(*) AS n FROM okreq GROUP BY ALL"
RAW["d5_misclassified"] = """SELECT request_id, phase, CASE WHEN critical_alert = 1 THEN 'FP' ELSE 'FN' END AS error_kind, round(score, 6) AS score, round(vote_ratio::DOUBLE, 6) AS vote_ratio,
 CASE WHEN k % 10 > 1 THEN round(k / 100.0::DOUBLE, 2) END AS psi FROM req WHERE ground_truth_drift <> critical_alert"""
RAW["d5_misclassified_counts"] = "SELECT count(*) FILTER (critical_alert = 1) AS FP, count(*) FILTER (critical_alert = 0) AS FN FROM req WHERE ground_truth_drift <> critical_alert"

RAW["j3_latest_action"] = """
SELECT e.event_id, a.action AS last_action, coalesce(a.action = 'freeze_adaptation', FALSE) AS frozen
FROM ev e ASOF LEFT JOIN (SELECT * FROM acts WHERE action <> 'refresh_reference') a ON e.ts_us >= a.ts_us"""
RAW["j4_baseline_vs_tuned"] = """SELECT phase, baseline_fp, tuned_fp, round(CASE WHEN baseline_fp > 0 THEN (baseline_fp - tuned_fp) / baseline_fp::DOUBLE * 100.0 ELSE 0.0 END, 6) AS reduction
FROM (SELECT phase, count(*) FILTER (ground_truth_drift = 0 AND fixed_alert = 1) AS baseline_fp, count(*) FILTER (ground_truth_drift = 0 AND critical_alert = 1) AS tuned_fp FROM req GROUP BY phase)"""
RAW["j6_zero_filled_severity"] = "SELECT s AS severity, (SELECT count(*) FROM al WHERE severity = s) AS count FROM (SELECT unnest(['low','medium','high','critical']) AS s)"

RAW["a1_reference_profile"] = "SELECT feature, " + ", ".join(f"round(edges[{i + 1}], 6) AS e{i}" for i in range(11)) + ", n, round(mean, 6) AS mean, round(std + 1e-9, 6) AS std FROM padded"
RAW["a1_exact_quantiles_distributed"] = "SELECT feature, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{int(p * 100)}" for p in (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)) + " FROM ref GROUP BY feature"
RAW["a2_histogram"] = f"SELECT c.feature, {_bin('c.value', 'p.edges')}::BIGINT AS bin, count(*) AS n FROM cur c JOIN padded p USING (feature) GROUP BY ALL"


def _two_sample(edges: str, ref_n: str, cur_n: str, share: str, cur_source: str, ref_source: str) -> str:
    return f"""
 SELECT e.feature, sum({_PSI_TERM}) AS psi FROM (
  SELECT e.feature, {share.format(c='coalesce(x.c, 0)', n=cur_n)} AS c, {share.format(c='coalesce(y.c, 0)', n=ref_n)} AS r
  FROM {edges} e CROSS JOIN bins10 b
  LEFT JOIN (SELECT c.feature, {_bin('c.value', 'e.edges')} AS bin, count(*) AS c FROM {cur_source} c JOIN {edges} e USING (feature) GROUP BY ALL) x ON x.feature = e.feature AND x.bin = b.bin
  LEFT JOIN (SELECT c.feature, {_bin('c.value', 'e.edges')} AS bin, count(*) AS c FROM {ref_source} c JOIN {edges} e USING (feature) GROUP BY ALL) y ON y.feature = e.feature AND y.bin = b.bin
 ) e GROUP BY e.feature"""


CTES["curspan"] = "SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS m FROM cur GROUP BY feature"
CTES["wide_edges"] = "SELECT feature, n, m, list_concat(list_concat([least(q[1], lo) - 1e-9], q[2:10]), [greatest(q[11], hi) + 1e-9]) AS edges FROM refq JOIN curspan USING (feature)"
CTES["wide_psi"] = _two_sample("wide_edges", "e.n", "e.m", "least(greatest({c} / {n}::DOUBLE, 1e-6), 1.0)", "cur", "ref")
RAW["a3_psi_widened"] = "SELECT feature, n AS n_r, m AS n_c, round(psi, 6) AS psi, psi >= 0.02 AS triggered FROM wide_psi JOIN wide_edges USING (feature)"
CTES["oddcur"] = "SELECT feature, value FROM cur WHERE value >= 1.0 AND value <= 200.0"
CTES["open_edges"] = "SELECT q.feature, q.n, c.m, list_concat(list_concat(['-inf'::DOUBLE], q.q[2:10]), ['inf'::DOUBLE]) AS edges FROM refq q JOIN (SELECT feature, count(*) AS m FROM oddcur GROUP BY 1) c USING (feature)"
CTES["open_psi"] = _two_sample("open_edges", "e.n", "e.m", "(CASE WHEN {c} = 0 THEN 1e-6 ELSE {c} / {n}::DOUBLE END)", "oddcur", "ref")
RAW["a5_psi_open"] = "SELECT feature, round(psi, 6) AS psi FROM open_psi"
CTES["ksrows"] = """
 SELECT feature, value, is_cur, sum(1 - is_cur) OVER w AS cr, sum(is_cur) OVER w AS cc, row_number() OVER (PARTITION BY feature, is_cur ORDER BY value) AS own,
  sum(1 - is_cur) OVER (PARTITION BY feature) AS n, sum(is_cur) OVER (PARTITION BY feature) AS m
 FROM (SELECT *, 0 AS is_cur FROM ref UNION ALL SELECT *, 1 FROM cur) WINDOW w AS (PARTITION BY feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["ksd"] = "SELECT feature, any_value(n)::BIGINT AS n_ref, any_value(m)::BIGINT AS n_cur, max(abs(cr / n - cc / m)) AS ks, max(abs(cr / n - own / m)) FILTER (is_cur = 1) AS ks_step FROM ksrows GROUP BY feature"
_X = "(ks * sqrt(n_ref * n_cur / (n_ref + n_cur)::DOUBLE))"
_KP = " + ".join(f"{'2.0' if j % 2 else '-2.0'} * exp(-{2.0 * j * j} * {_X} * {_X})" for j in range(1, 41))
RAW["a7_a8_ks"] = f"""SELECT feature, n_ref, n_cur, round(ks, 6) AS ks, round(ks_step, 6) AS ks_step, round(sqrt(-0.5 * ln(0.0005)) * sqrt((n_ref + n_cur) / (n_ref * n_cur)::DOUBLE), 6) AS ks_critical,
 round(p, 6) AS p_value, p < 0.001 AS triggered FROM (SELECT *, CASE WHEN {_X} < 0.2 THEN 1.0 ELSE least(greatest({_KP}, 0.0), 1.0) END AS p FROM ksd)"""
RAW["a4_a6_a9_window_distances"] = "SELECT u, feature, n_cur, round(psi, 5) AS psi, round(ks, 5) AS ks, round(ks_critical, 5) AS ks_critical, round(mean_shift_z, 5) AS mean_shift_z FROM dist"
RAW["a10_profile_moments"] = "SELECT feature, n, round(mean + 1e-8, 5) AS mean, round(std, 5) AS std FROM prof"
RAW["a4_profile_shares"] = "SELECT feature, (bin - 1)::BIGINT AS bin, round(r, 6) AS share FROM refshare"
RAW["a11_zscore_model"] = "SELECT n, round(norm_mean, 4) AS norm_mean, round(norm_scale, 4) AS norm_scale FROM zmodel"
RAW["a12_normalizer"] = "SELECT round(raw_mean, 6) + 0.0 AS raw_mean, round(raw_std, 6) AS raw_std FROM nmodel"
RAW["a13_percentiles"] = "SELECT endpoint, " + ", ".join(f"round(quantile_cont(latency_ms, {p}), 6) AS {n}" for n, p in ops.LATENCY_LEVELS.items()) + " FROM req GROUP BY endpoint"
RAW["a14_alert_quality"] = f"""SELECT merchant_category, alerts, denominator, tp, fp, fn, tn, drift_events, non_drift_events, round(alerts / denominator::DOUBLE, 6) AS anomaly_rate,
 round(CASE WHEN alerts > 0 THEN fp / alerts::DOUBLE ELSE 0.0 END, 6) AS false_alert_rate, round(CASE WHEN drift_events > 0 THEN tp / drift_events::DOUBLE ELSE 0.0 END, 6) AS alert_rate_drift,
 round(CASE WHEN non_drift_events > 0 THEN fp / non_drift_events::DOUBLE ELSE 0.0 END, 6) AS alert_rate_non_drift, TRUE AS labels_available
FROM (SELECT merchant_category, count(*) FILTER (is_anomaly) AS alerts, count(*) AS denominator, {_confusion('drift', 'is_anomaly')}, count(*) FILTER (drift) AS drift_events, count(*) FILTER (NOT drift) AS non_drift_events FROM judged99 GROUP BY 1)"""
_T, _ND = "TRUE", "NULL::DOUBLE"
RAW["a14_alert_quality_unlabelled"] = f"""SELECT merchant_category, count(*) FILTER (is_anomaly) AS alerts, count(*) AS denominator, {_T} AS tp, {_T} AS fp, {_T} AS fn, {_T} AS tn, {_T} AS drift_events, {_T} AS non_drift_events,
 round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS anomaly_rate, {_ND} AS false_alert_rate, {_ND} AS alert_rate_drift, {_ND} AS alert_rate_non_drift, FALSE AS labels_available FROM judged99 GROUP BY 1"""
for _name, _key in (("a15_confusion", "endpoint"), ("a16_phase_confusion", "phase")):
    RAW[_name] = f"SELECT {_key}, points, tp, fp, fn, tn, {_rates()} FROM (SELECT {_key}, count(*) AS points, {_confusion('ground_truth_drift = 1', 'critical_alert = 1')} FROM req GROUP BY 1)"


def _delay(after: bool, seconds: str) -> str:
    later = "AND j.t >= o.t0" if after else ""
    return f"""SELECT merchant_category, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN greatest(0, t1 - t0) END::BIGINT AS events_to_detect, round({seconds}, 3) AS seconds_to_detect FROM (
 SELECT merchant_category, any_value(o.t0) AS t0, any_value(o.s0) AS s0, min(j.t) FILTER (is_anomaly {later}) AS t1, min(j.ts_us) FILTER (is_anomaly {later}) AS s1
 FROM judged99 j JOIN (SELECT merchant_category, min(t) FILTER (drift) AS t0, min(ts_us) FILTER (drift) AS s0 FROM judged99 GROUP BY 1) o USING (merchant_category) GROUP BY 1)"""


_BY_TS = "CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN greatest(0.0, (s1 - s0) / 1e6) END"
RAW["a17_detection_delay"] = _delay(False, _BY_TS)
RAW["a17_detection_delay_after_onset"] = _delay(True, _BY_TS)
RAW["a17_detection_delay_by_rate"] = _delay(True, "CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN greatest(0, t1 - t0) / 585.0::DOUBLE END")
RAW["a18_fp_reduction"] = """SELECT endpoint, round(CASE WHEN b > 0 THEN (b - c) / b::DOUBLE * 100.0 ELSE 0.0 END, 6) AS reduction, round((b - c) / greatest(b, 1)::DOUBLE * 100.0, 6) AS reduction_floored
FROM (SELECT endpoint, count(*) FILTER (ground_truth_drift = 0 AND fixed_alert = 1) AS b, count(*) FILTER (ground_truth_drift = 0 AND critical_alert = 1) AS c FROM req GROUP BY 1)"""
RAW["a19_gates"] = """SELECT merchant_category, rate <= 0.05 AS hard, abs(rate - 0.05) <= 0.03 AS near, abs(rate - 0.5) <= 0.001 OR alerts > 80 AS waived, round(a * b / greatest(1e-9, a), 6) AS throughput_ratio,
 round(b * 1.1::DOUBLE / greatest(1e-9, b), 6) AS p99_ratio, a * b / greatest(1e-9, a) >= 0.95 AND b * 1.1::DOUBLE / greatest(1e-9, b) <= 1.15 AS performance_passed, alerts >= 70 AS enough
FROM (SELECT merchant_category, avg(is_anomaly::INT) AS rate, count(*) FILTER (is_anomaly) AS alerts, avg(amount) AS a, avg(score) AS b FROM judged99 GROUP BY 1)"""
RAW["a20_run_summary"] = """SELECT total AS requests_total, ok AS requests_ok, round(d, 4) AS duration_s, round(p50, 4) AS latency_p50_ms, round(p95, 4) AS latency_p95_ms, round(p99, 4) AS latency_p99_ms,
 round(total / d, 4) AS sustained_rps, round((total - ok) / total::DOUBLE * 100.0, 4) AS error_rate_percent, round(ok / total::DOUBLE * 100.0, 4) AS uptime_percent FROM (
 SELECT count(*) AS total, count(*) FILTER (status_code >= 200 AND status_code < 400) AS ok, greatest(1e-9, max(timestamp) - min(timestamp)) AS d,
  quantile_cont(latency_ms, 0.5) FILTER (status_code >= 200 AND status_code < 400) AS p50, quantile_cont(latency_ms, 0.95) FILTER (status_code >= 200 AND status_code < 400) AS p95,
  quantile_cont(latency_ms, 0.99) FILTER (status_code >= 200 AND status_code < 400) AS p99 FROM req)"""
CTES["res"] = f"""SELECT merchant_category AS host, ts_us / 1e6 AS ts, CASE WHEN k = 3 THEN 0.0 ELSE (ts_us - {I.RUN_START}) / 1e8 + k END AS cpu, amount AS mb,
 CASE WHEN k % 4 = 0 THEN k / 2.0 ELSE 0.0 END::DOUBLE AS pct, lag(CASE WHEN k = 3 THEN 0.0 ELSE (ts_us - {I.RUN_START}) / 1e8 + k END) OVER w AS prev, lag(ts_us / 1e6) OVER w AS prev_ts
 FROM ev WINDOW w AS (PARTITION BY merchant_category ORDER BY ts_us)"""
CTES["cpusamples"] = """SELECT host, pct AS v FROM res WHERE pct > 0 UNION ALL
 SELECT host, (cpu - prev) / (ts - prev_ts) * 100.0 FROM res WHERE prev IS NOT NULL AND ts > prev_ts AND cpu >= prev AND (prev > 0 OR cpu > 0)"""
RAW["a21_cpu_memory"] = """SELECT host, round(c.a, 4) AS cpu_avg_percent, round(c.p, 4) AS cpu_p95_percent, round(m.a, 4) AS memory_avg_mb, round(m.p, 4) AS memory_p95_mb
FROM (SELECT host, avg(v) AS a, quantile_cont(v, 0.95) AS p FROM cpusamples GROUP BY 1) c JOIN (SELECT host, avg(mb) AS a, quantile_cont(mb, 0.95) AS p FROM res GROUP BY 1) m USING (host)"""
RAW["a22_traffic_mix"] = "SELECT endpoint, phase, count(*) AS requests FROM req GROUP BY GROUPING SETS ((endpoint), (phase))"
RAW["a23_ingest_counters"] = "SELECT s AS source, (SELECT count(*) FROM copies WHERE source = s) AS count FROM (SELECT unnest(['stream', 'api']) AS s)"
RAW["a24_lag_histogram"] = "SELECT le, bucket, round((SELECT sum(lag_s) FROM lagrows), 4) AS total FROM (" + " UNION ALL ".join(
    f"SELECT '{e}' AS le, (SELECT count(*) FROM lagrows WHERE lag_s <= {e}) AS bucket" for e in ops.LAG_EDGES
) + " UNION ALL SELECT '+Inf', (SELECT count(*) FROM lagrows))"
CTES["compn"] = "SELECT run, count(*) AS n FROM (SELECT CASE WHEN k % 2 = 0 THEN 'baseline' ELSE 'tuned' END AS run FROM ev) GROUP BY 1"
CTES["comp"] = """SELECT run, component, sum(ms) / any_value(n) AS ms FROM (SELECT run, unnest(['features','scoring','change_detection','distances','control']) AS component,
  unnest([a / 1e4, a / 1e2 + k % 2, k / 1e4, k / 1e3 + k % 2 * 0.5::DOUBLE, a / 1e5]) AS ms FROM (SELECT CASE WHEN k % 2 = 0 THEN 'baseline' ELSE 'tuned' END AS run, amount AS a, k FROM ev)) JOIN compn USING (run) GROUP BY run, component"""
RAW["a25_component_profile"] = "SELECT run, component, round(ms, 6) AS ms_per_event, round(ms / greatest(1e-9, sum(ms) OVER (PARTITION BY run)) * 100.0, 6) AS percent_of_total FROM comp"
RAW["a25_top_regressions"] = """SELECT component, round(b.ms, 6) AS baseline_ms, round(t.ms, 6) AS tuned_ms, round(t.ms - b.ms, 6) AS delta_ms, round((t.ms - b.ms) / greatest(1e-9, b.ms) * 100.0, 6) AS delta_percent
FROM (SELECT * FROM comp WHERE run = 'baseline') b JOIN (SELECT * FROM comp WHERE run = 'tuned') t USING (component) ORDER BY t.ms - b.ms DESC, component LIMIT 3"""
_WRONG = " OR ".join(f"(phase = '{p}' AND ground_truth_drift <> {v})" for p, v in PHASE_LABELS.items())
RAW["a26_phase_label_check"] = f"SELECT count(*) AS checked_rows, count(*) FILTER ({_WRONG}) AS mismatches, count(*) FILTER ({_WRONG}) = 0 AS valid FROM req"
RAW["a27_availability"] = "SELECT event_id, round(CASE WHEN k - 10 > 0 THEN greatest(0.0, least(1.0, 1.0 - greatest(0.0, amount - 30.0) / (k - 10))) * 100.0 ELSE 0.0 END, 6) AS availability FROM ev"
RAW["a29_recent_rate"] = f"SELECT 'main' AS stream_id, 0.99::DOUBLE AS threshold, round(avg((score >= 0.99)::INT), 6) AS recent_rate FROM scored WHERE t > (SELECT max(t) FROM scored) - {CC.history}"
CTES["latseries"] = """SELECT idx, p FROM (SELECT idx, quantile_cont(latency_ms, 0.95) OVER (ORDER BY idx ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS p FROM numreq) WHERE idx % 250 = 0"""
RAW["a30_rolling_summary"] = "SELECT 'run' AS stream_id, round(avg(p), 6) AS avg_ms, round(max(p), 6) AS max_ms, round(max_by(p, idx), 6) AS latest_ms FROM latseries"
RAW["w1_entity_features"] = f"SELECT {_FEAT_OUT} FROM feat"
RAW["w1_entity_features_range"] = RAW["w1_entity_features"]
CTES["capped8"] = _capped(8)
RAW["w1_entity_features_capped"] = f"SELECT {_FEAT_OUT} FROM capped8"
RAW["w1_entity_features_range_capped"] = RAW["w1_entity_features_capped"]
RAW["w2_time_since_last"] = "SELECT event_id, round(least(coalesce((ts_us - lag(ts_us) OVER (PARTITION BY entity_id ORDER BY ts_us, event_id)) / 1e6, 1e6), 1e6), 6) AS gap_s FROM ev"
RAW["w3_window_contents"] = f"SELECT event_id, count(*) OVER w AS n, round(coalesce(max(amount) OVER w, 0.0), 6) AS top, coalesce(min(ts_us) OVER w, -1) AS oldest_us FROM ev WINDOW w AS {_FRAME}"
RAW["w4_event_index"] = "SELECT event_id, idx, CASE WHEN idx <= 1500 THEN 'warming_up' WHEN idx <= 3500 THEN 'reference' ELSE 'current' END AS phase FROM feat"
RAW["w6_count_windows"] = """SELECT w AS window_id, count(*) AS n, min(idx) AS first, round(avg(feature_1), 4) AS mean
FROM ftabx JOIN (SELECT unnest(range(0, (SELECT max(idx) FROM ftabx) // 250 + 1)) AS w) ON idx > 5000 + w * 250 AND idx <= 5000 + w * 250 + 1000 GROUP BY w"""
RAW["w7_window_psi"] = "SELECT window_id, start_idx, end_idx, start_us, end_us, true_drift::BIGINT AS true_drift, round(max_psi, 6) AS max_psi FROM a_rows"
RAW["w8_trailing_threshold"] = "SELECT window_id, round(max_psi, 6) AS max_psi, round(adaptive_threshold, 6) AS adaptive_threshold, alert_fixed::BIGINT AS alert_fixed, alert_adaptive::BIGINT AS alert_adaptive FROM b_alerts"
RAW["w8_trailing_threshold_streams"] = " UNION ALL ".join(
    f"SELECT '{s.upper()}' AS stream_id, window_id, start_us, true_drift::BIGINT AS true_drift, round(max_psi, 6) AS max_psi, round(adaptive_threshold, 6) AS adaptive_threshold, "
    f"alert_fixed::BIGINT AS alert_fixed, alert_adaptive::BIGINT AS alert_adaptive FROM {s}3_alerts"
    for s in "anr"
)
RAW["w10_drift_segments_streams"] = " UNION ALL ".join(
    f"SELECT '/{e}' AS stream_id, first_pos, last_pos, start_us, detected, coalesce(detected_pos, -1) AS detected_pos FROM reqseg_{e}" for e in ("score", "predict", "detect_drift")
)
RAW["a13_percentiles_odd_values"] = """SELECT feature, round(min(value), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(max(value), 6) AS top
FROM (SELECT feature, CASE WHEN value > 200.0 THEN 'inf'::DOUBLE ELSE value END AS value FROM ref WHERE value >= 1.0) GROUP BY feature"""
CTES["trail"] = "SELECT ts_us, 1 AS now, count(*) OVER (ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM judged99 WHERE is_anomaly"
RAW["w9_trailing_alerts"] = "SELECT ts_us, now::BIGINT AS alerts_now, n AS alerts_trailing FROM trail"
RAW["w9_alert_rate_summary"] = "SELECT 'main' AS stream_id, round(avg(n), 6) AS avg_alerts_per_minute, max(n)::DOUBLE AS max_alerts_per_minute, max(n) > 5 AS cap_breached FROM trail"
RAW["w10_drift_segments"] = "SELECT * EXCLUDE (latency_windows) REPLACE (round(latency_s, 6) AS latency_s, coalesce(detected_pos, -1) AS detected_pos, coalesce(detected_us, -1) AS detected_us) FROM reqseg"
RAW["w10_segment_summary"] = f"SELECT {_found('reqseg')}, round(coalesce((SELECT quantile_cont(latency_s, 0.95) FROM reqseg WHERE detected), 0.0), 3) AS p95_latency_s"
RAW["w11_rolling_latency"] = "SELECT idx, round(p, 6) AS rolling_p95_ms FROM latseries"
RAW["l1_newest_alerts"] = "SELECT alert_id, ts_us, severity FROM al ORDER BY ts_us DESC, alert_id DESC LIMIT 200"
RAW["l3_requests_by_time"] = "SELECT request_id, round(timestamp, 6) AS timestamp, round(latency_ms, 6) AS latency_ms FROM req ORDER BY timestamp"
RAW["t1_drift_fusion"] = """SELECT u, round(psi_component, 5) AS psi_component, round(ks_component, 5) AS ks_component, round(prediction_component, 5) AS prediction_component, round(vote_ratio, 5)::DOUBLE AS vote_ratio,
 round(mean_fusion, 5) AS mean_fusion, round(psi_component + ks_component + prediction_component, 5) AS drift_score, psi_component + ks_component + prediction_component >= 0.8 AND vote_ratio >= 0.35 AS drift_fixed_active FROM fused"""
CTES["tickq"] = f"SELECT t, ts_us, event_id, least(t, {CC.history}) AS n_history, q FROM (SELECT t, ts_us, event_id, quantile_cont(score, 0.99) OVER (ORDER BY t ROWS BETWEEN {CC.history - 1} PRECEDING AND CURRENT ROW) AS q FROM scored) WHERE t % {CC.interval} = 0"
RAW["t5_tick_quantiles"] = f"SELECT t, n_history, CASE WHEN n_history >= {CC.min_history} THEN round(q, 6) END AS proposal FROM tickq"
RAW["t8_lag_circuit"] = """SELECT event_id, ts_us, round(lag_s, 6) AS lag_s FROM (
 SELECT l.*, row_number() OVER (PARTITION BY r.ts_us ORDER BY l.ts_us, l.event_id) AS rn FROM (SELECT * FROM lagrows WHERE lag_s > 5.0) l ASOF LEFT JOIN (SELECT ts_us FROM acts WHERE action = 'unfreeze_adaptation') r ON l.ts_us >= r.ts_us) WHERE rn = 1"""
RAW["t9_control_audit"] = f"""SELECT ts_us, action, coalesce(actor, 'unknown') AS actor, coalesce(reason, CASE action WHEN '{control.FREEZE}' THEN 'manual_freeze' WHEN '{control.UNFREEZE}' THEN 'manual_unfreeze' ELSE 'manual_reference_refresh' END) AS reason FROM acts"""
RAW["m1_zscore_raw"] = "SELECT event_id, t, round(raw_score, 5) AS raw_score FROM scored"
RAW["m3_scorer_lifecycle"] = "SELECT 'warming_up' AS status, count(*) AS n, min(idx) AS first, max(idx) AS last, NULL::DOUBLE AS score FROM feat WHERE idx <= 1500 UNION ALL SELECT 'scored', count(*), min(idx), max(idx), round(sum(score), 3) FROM scored"
RAW["c2_drift_report"] = f"""SELECT d AS detector, points, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, segments_total, segments_detected, avg_latency_s, avg_latency_windows,
 round((ffp - fp) / greatest(ffp, 1)::DOUBLE * 100.0, 4) AS false_alert_reduction FROM (
 SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r, max(CASE WHEN d = 'alert_fixed' THEN fp END) OVER () AS ffp FROM (
 SELECT 'alert_fixed' AS d, count(*) AS points, {_confusion('true_drift = 1', 'alert_fixed = 1')}, {_found('bseg_f', 4)}, round(coalesce((SELECT avg(latency_windows) FROM bseg_f WHERE detected), 0.0), 4) AS avg_latency_windows FROM b_alerts
 UNION ALL SELECT 'alert_adaptive', count(*), {_confusion('true_drift = 1', 'alert_adaptive = 1')}, {_found('bseg_a', 4)}, round(coalesce((SELECT avg(latency_windows) FROM bseg_a WHERE detected), 0.0), 4) FROM b_alerts))"""

RAW["c2_drift_report_streams"] = " UNION ALL ".join(
    f"SELECT '{s.upper()}' AS stream_id, * FROM (" + RAW["c2_drift_report"].replace("b_alerts", f"{s}3_alerts").replace("bseg_f", f"{s}3seg_f").replace("bseg_a", f"{s}3seg_a") + ")"
    for s in "anr"
)


def _run_eval(name: str, column: str, seg: str) -> str:
    return f"""SELECT '{name}' AS detector, points, tp, fp, fn, tn, {_rates().replace(', 6)', ', 3)')}, {_found(seg)}, round(coalesce((SELECT quantile_cont(latency_s, 0.95) FROM {seg} WHERE detected), 0.0), 3) AS p95_latency_s
 FROM (SELECT count(*) AS points, {_confusion('ground_truth_drift = 1', column + ' = 1')} FROM runreq)"""


RAW["c3_run_evaluation"] = f"""SELECT *, round(CASE WHEN ffp > 0 THEN (ffp - fp) / ffp::DOUBLE * 100.0 ELSE 0.0 END, 3) AS false_alert_reduction FROM (
 {_run_eval('fixed_baseline', 'fixed_alert', 'runseg_f')} UNION ALL {_run_eval('adaptive', 'critical_alert', 'runseg_c')}) CROSS JOIN (SELECT count(*) FILTER (ground_truth_drift = 0 AND fixed_alert = 1) AS ffp FROM runreq)""".replace("SELECT *, round(CASE WHEN ffp", "SELECT * EXCLUDE (ffp), round(CASE WHEN ffp", 1)
RAW["c3_run_phases"] = f"SELECT phase, points, tp, fp, fn, tn, {_rates()} FROM (SELECT phase, count(*) AS points, {_confusion('ground_truth_drift = 1', 'critical_alert = 1')} FROM runreq GROUP BY phase)"
RAW["c3_run_labels"] = RAW["a26_phase_label_check"].replace("FROM req", "FROM runreq")
RAW["c3_run_errors"] = RAW["d5_misclassified"].replace("FROM req", "FROM runreq")
RAW["c3_run_summary"] = RAW["a20_run_summary"]
for _e in ("score", "predict", "detect_drift"):
    CTES[f"runreq_{_e}"] = f"SELECT *, row_number() OVER (ORDER BY ts_us, request_id) AS pos FROM runreq WHERE endpoint = '/{_e}'"
    CTES[f"runseg_{_e}_f"] = _segments(f"runreq_{_e}", "pos", "ts_us", "ground_truth_drift", "fixed_alert")
    CTES[f"runseg_{_e}_c"] = _segments(f"runreq_{_e}", "pos", "ts_us", "ground_truth_drift", "critical_alert")
RAW["c3_run_evaluation_streams"] = " UNION ALL ".join(
    f"""SELECT '/{e}' AS stream_id, '{name}' AS detector, points, tp, fp, fn, tn, round(CASE WHEN ffp > 0 THEN (ffp - fp) / ffp::DOUBLE * 100.0 ELSE 0.0 END, 3) AS false_alert_reduction,
 (SELECT count(*) FROM runseg_{e}_{seg}) AS segments_total, (SELECT count(*) FILTER (detected) FROM runseg_{e}_{seg}) AS segments_detected
 FROM (SELECT count(*) AS points, {_confusion('ground_truth_drift = 1', column + ' = 1')}, count(*) FILTER (ground_truth_drift = 0 AND fixed_alert = 1) AS ffp FROM runreq_{e})"""
    for e in ("score", "predict", "detect_drift")
    for name, column, seg in (("fixed_baseline", "fixed_alert", "f"), ("adaptive", "critical_alert", "c"))
)
CTES["phaserank"] = "SELECT *, row_number() OVER (PARTITION BY phase ORDER BY ts_us, request_id) AS rk, count(*) OVER (PARTITION BY phase) AS size FROM req WHERE drift_evaluated = 1"
CTES["trainflag"] = "SELECT *, rk <= greatest(1, floor(size * 0.8::DOUBLE)) AS train FROM phaserank"
CTES["splitrows"] = """SELECT *, row_number() OVER (PARTITION BY train ORDER BY ts_us, request_id) AS pos, least(4, greatest(2, (SELECT count(*) FROM trainflag WHERE train) // 20)) AS folds FROM trainflag"""
RAW["t11_split"] = "SELECT request_id AS event_id, phase, (CASE WHEN train THEN (pos - 1) % folds ELSE -1 END)::BIGINT AS fold, pos FROM splitrows"


# --- folds as recursive expressions --------------------------------------------------------
_ARR = {n: "[" + ", ".join(f"max({e}) FILTER (feature = '{f}')" for f in FEATURES) + "]" for n, e in (
    ("psi", "psi"), ("kr", "ks / greatest(1e-9, ks_critical)"), ("z", "mean_shift_z"))}
CTES["evrows"] = f"""
 SELECT u, row_number() OVER (ORDER BY u) AS i, psi, kr, z, sp, sk FROM (SELECT u, {_ARR['psi']} AS psi, {_ARR['kr']} AS kr, {_ARR['z']} AS z,
  max(psi) FILTER (feature = 'score') AS sp, max(ks / greatest(1e-9, ks_critical)) FILTER (feature = 'score') AS sk FROM dist GROUP BY u)"""


def _lim(hist: str, floor: float) -> str:
    q = f"list_transform(range(1, 9), lambda f: greatest({floor}, list_aggregate(list_transform({hist}, lambda h: h[f]), 'quantile_cont', 0.9) + 1.5 * list_aggregate(list_transform({hist}, lambda h: h[f]), 'stddev_pop')))"
    return f"CASE WHEN len({hist}) >= {DC.baseline_min_evals} THEN {q} ELSE list_transform(range(1, 9), lambda f: {floor}::DOUBLE) END"


def _fold(latched: bool, adaptive: bool, need: int) -> str:
    damp = "least(ln(1 + greatest(0.0, {x})), 3.0)"
    limit = f"CASE WHEN len(scores) >= {DC.baseline_min_evals} THEN greatest(0.8, list_aggregate(scores, 'quantile_cont', 0.9)) ELSE 0.8 END" if adaptive else "0.8::DOUBLE"
    was_w, was_c = ("won", "con") if latched else ("FALSE", "FALSE")
    return f"""
 SELECT 0::BIGINT AS i, 0::BIGINT AS u, []::DOUBLE[] AS scores, []::DOUBLE[][] AS hp, []::DOUBLE[][] AS hk, 0 AS wrun, 0 AS crun, FALSE AS won, FALSE AS con, -1000000000::BIGINT AS last,
  0.0::DOUBLE AS score, 0.0::DOUBLE AS lim, 0.0::DOUBLE AS vote, 0.0::DOUBLE AS mf, 0.0::DOUBLE AS pc, 0.0::DOUBLE AS kc, 0.0::DOUBLE AS rc
 UNION ALL
 SELECT i, u, CASE WHEN learn THEN list_append(scores, score) ELSE scores END, CASE WHEN learn THEN list_append(hp, psi) ELSE hp END, CASE WHEN learn THEN list_append(hk, kr) ELSE hk END,
  wrun2, crun2, won2, CASE WHEN {was_c} AND chit THEN TRUE ELSE crun2 >= {need} AND u - last >= {DC.alert_cooldown_events} END,
  CASE WHEN NOT ({was_c} AND chit) AND crun2 >= {need} AND u - last >= {DC.alert_cooldown_events} THEN u ELSE last END, score, lim, vote, mf, pc, kc, rc
 FROM (SELECT *, CASE WHEN chit THEN crun + 1 ELSE 0 END AS crun2, (vote <= 0.2 * 0.8 AND NOT {was_c}) OR len(scores) < 60 AS learn
  FROM (SELECT *, CASE WHEN {was_c} THEN score >= lim * 0.8 AND vote >= 0.35 * 0.8 ELSE won2 AND score >= lim AND vote >= 0.35 AND mf >= 0.65 END AS chit
   FROM (SELECT *, CASE WHEN whit THEN wrun + 1 ELSE 0 END AS wrun2, whit AS won2
    FROM (SELECT *, CASE WHEN {was_w} THEN score >= lim * 0.6 AND vote >= 0.2 * 0.8 ELSE score >= lim * 0.8 AND vote >= 0.2 AND mf >= 0.65 * 0.9 END AS whit
     FROM (SELECT *, pc + kc + rc AS score, len(list_filter(fus, lambda x: x >= 0.65)) / 8.0::DOUBLE AS vote, list_avg(fus) AS mf
      FROM (SELECT *, 0.5 * list_avg(pn) AS pc, 0.3 * list_avg(kn) AS kc, 0.2 * (0.5 * {damp.format(x='sp / 0.25')} + 0.5 * {damp.format(x='sk')}) AS rc,
        list_transform(range(1, 9), lambda f: 0.55 * pn[f] + 0.30 * kn[f] + 0.15 * {damp.format(x='z[f] / 2.5')}) AS fus
       FROM (SELECT *, list_transform(range(1, 9), lambda f: {damp.format(x='psi[f] / greatest(1e-9, pl[f])')}) AS pn, list_transform(range(1, 9), lambda f: {damp.format(x='kr[f] / greatest(1e-9, kl[f])')}) AS kn
        FROM (SELECT e.i, e.u, e.psi, e.kr, e.z, e.sp, e.sk, p.scores, p.hp, p.hk, p.wrun, p.crun, p.won, p.con, p.last, {limit} AS lim, {_lim('p.hp', 0.25)} AS pl, {_lim('p.hk', 1.0)} AS kl
         FROM @self p JOIN evrows e ON e.i = p.i + 1))))))))"""


CTES["states"] = _fold(False, True, DC.critical_consecutive)
CTES["latch"] = _fold(True, False, 2)
CTES["stateout"] = "SELECT s.*, d.score >= 0.8 AND d.vote >= 0.35 AS fixed, j.ts_us, j.drift_tag, j.event_id FROM states s JOIN states d USING (i) JOIN scored j ON j.t = s.u + 2000 WHERE s.i > 0"
RAW["t2_t3_drift_states"] = """SELECT u, round(score, 5) AS drift_score, round(lim, 5) AS drift_threshold, round(vote, 5) AS vote_ratio, round(mf, 5) AS mean_fusion,
 score >= 0.8 AND vote >= 0.35 AS drift_fixed_active, won AS drift_warning_active, con AS drift_active FROM states WHERE i > 0"""
RAW["t3_drift_states_latched"] = "SELECT u, round(score, 5) AS drift_score, won AS drift_warning_active, con AS drift_active, score >= 0.8 AND vote >= 0.35 AS drift_fixed_active FROM latch WHERE i > 0"


def _path(ticks: str, cfg) -> str:
    """Threshold after every tick of ``ticks`` (i, t, ts_us, event_id, q, n, om, um, drift, frozen)."""
    feedback = (
        f"CASE WHEN om >= thr AND tgt < thr THEN thr + {cfg.max_step} WHEN um < thr AND tgt > thr THEN thr - {cfg.max_step} ELSE tgt END" if cfg.rate_feedback else "tgt"
    )
    blocked = "open AND ((om >= thr AND tgt < thr) OR (um < thr AND tgt > thr))" if cfg.rate_feedback else "FALSE"
    drift = "TRUE" if cfg.adapt_during_drift else "NOT drift"
    return f"""
 SELECT 0::BIGINT AS i, 0::BIGINT AS t, 0::BIGINT AS ts_us, ''::VARCHAR AS event_id, NULL::DOUBLE AS q, {cfg.initial_threshold}::DOUBLE AS old, {cfg.initial_threshold}::DOUBLE AS thr, 0::BIGINT AS cus,
  {cfg.initial_threshold}::DOUBLE AS lg, 0::BIGINT AS lus, FALSE AS bnd, FALSE AS stp, FALSE AS blk, FALSE AS aud
 UNION ALL
 SELECT i, t, ts_us, event_id, q, thr, nw, CASE WHEN nw <> thr THEN ts_us ELSE cus END, CASE WHEN aud THEN nw ELSE lg END, CASE WHEN aud THEN ts_us ELSE lus END, bnd, stp, blk, aud
 FROM (SELECT *, nw <> thr AND (abs(nw - lg) >= {cfg.audit_min_delta} OR (ts_us - lus) / 1e6 >= {cfg.audit_cooldown_seconds}) AS aud
  FROM (SELECT *, CASE WHEN open THEN {feedback} ELSE thr END AS nw, {blocked} AS blk
   FROM (SELECT *, open AND pc <> q AS bnd, open AND abs(pc - thr) > {cfg.max_step} AS stp,
     CASE WHEN abs(pc - thr) > {cfg.max_step} THEN thr + {cfg.max_step} * sign(pc - thr) ELSE pc END AS tgt
    FROM (SELECT k.*, p.thr, p.cus, p.lg, p.lus, least({cfg.max_threshold}, greatest({cfg.min_threshold}, k.q)) AS pc,
      {drift} AND NOT k.frozen AND NOT (p.cus <> 0 AND (k.ts_us - p.cus) / 1e6 < {cfg.cooldown_seconds}) AND k.n >= {cfg.min_history} AS open
     FROM @self p JOIN {ticks} k ON k.i = p.i + 1))))"""


CTES["ticks1"] = f"""SELECT row_number() OVER (ORDER BY k.t) AS i, k.t, k.ts_us, k.event_id, k.q, k.n_history AS n, 0.0 AS om, 0.0 AS um, coalesce(s.con, FALSE) AS drift, FALSE AS frozen
 FROM tickq k LEFT JOIN states s ON s.i > 0 AND s.u = k.t - {DC.reference_events}"""
CTES["path1"] = _path("ticks1", CC)
CTES["judged"] = f"""SELECT j.*, coalesce(p.thr, {CC.initial_threshold}) AS thr, j.score >= coalesce(p.thr, {CC.initial_threshold}) AS is_anomaly, s.i IS NOT NULL AS evaluated,
  coalesce(s.con, FALSE) AS con, coalesce(s.won, FALSE) AS won, coalesce(l.score, 0.0) AS ds, coalesce(l.vote, 0.0) AS vr
 FROM scored j LEFT JOIN path1 p ON p.i > 0 AND p.i = j.t // {CC.interval} LEFT JOIN states s ON s.i > 0 AND s.u = j.t - {DC.reference_events}
 LEFT JOIN states l ON l.i > 0 AND l.u = ((j.t - {DC.reference_events}) // {DC.interval}) * {DC.interval}"""
RAW["t5_threshold_path"] = f"SELECT t, CASE WHEN least(t, {CC.history}) >= {CC.min_history} THEN round(q, 6) END AS proposal, round(thr, 6) AS threshold, thr <> old AS changed, bnd AS bounds_limited, stp AS step_limited FROM path1 WHERE i > 0"
RAW["j2_threshold_in_force"] = "SELECT event_id, t, round(thr, 6) AS threshold, is_anomaly FROM judged"
RAW["t7_audit"] = """SELECT t, event_id, round(old, 6) AS old_threshold, round(thr, 6) AS new_threshold, 'controller' AS actor, 'target_anomaly_rate_control' AS reason
FROM path1 WHERE aud AND ('0x' || substr(sha256('threshold-log-sample|' || event_id || '|'), 1, 8))::BIGINT / 4294967295.0 < 0.5"""
CTES["reasons"] = f"""SELECT CASE WHEN coalesce(s.con, FALSE) THEN 'drift' WHEN coalesce(p.cus, 0) <> 0 AND (j.ts_us - p.cus) / 1e6 < {CC.cooldown_seconds} THEN 'cooldown'
  WHEN least(j.t, {CC.history}) < {CC.min_history} THEN 'history' WHEN j.t % {CC.interval} <> 0 THEN 'interval' END AS why
 FROM scored j LEFT JOIN path1 p ON p.i > 0 AND p.i = (j.t - 1) // {CC.interval} LEFT JOIN states s ON s.i > 0 AND s.u = j.t - {DC.reference_events}"""
_SKIP = ", ".join(f"(SELECT count(*) FROM reasons WHERE why = '{w}') AS skipped_{w}" for w in ("drift", "cooldown", "history", "interval"))
RAW["t6_control_counters"] = f"SELECT {_SKIP}, 0::BIGINT AS frozen_events, count(*) FILTER (thr <> old) AS updates_applied, count(*) FILTER (stp) AS step_limited, count(*) FILTER (bnd) AS bounds_limited, count(*) FILTER (blk) AS feedback_blocked FROM path1 WHERE i > 0"
FB = I.FEEDBACK
_UP, _LOW = FB.target_rate + FB.tolerance, FB.target_rate - FB.tolerance
CTES["fbwin"] = f"SELECT t, ts_us, event_id, least(t, {FB.history}) AS n, list(score) OVER (ORDER BY t ROWS BETWEEN {FB.history - 1} PRECEDING AND CURRENT ROW) AS w FROM scored"
CTES["fbticks"] = f"""SELECT row_number() OVER (ORDER BY t) AS i, t, ts_us, event_id, n, list_aggregate(w, 'quantile_cont', 0.99) AS q, coalesce(list_reverse_sort(w)[len(list_filter(range(1, n + 1), lambda c: c / n::DOUBLE <= {_UP!r})) + 1], '-inf'::DOUBLE) AS om,
  coalesce(list_reverse_sort(w)[len(list_filter(range(1, n + 1), lambda c: c / n::DOUBLE < {_LOW!r})) + 1], '-inf'::DOUBLE) AS um, FALSE AS drift, FALSE AS frozen FROM fbwin WHERE t % {FB.interval} = 0"""
CTES["fbpath"] = _path("fbticks", FB)
RAW["t5_rate_feedback"] = f"SELECT t, CASE WHEN least(t, {FB.history}) >= {FB.min_history} THEN round(q, 6) END AS proposal, round(thr, 6) AS threshold, stp AS step_limited, blk AS feedback_blocked FROM fbpath WHERE i > 0"
CTES["opened"] = """SELECT ts_us + 1 AS ts_us FROM (SELECT l.*, row_number() OVER (PARTITION BY r.ts_us ORDER BY l.ts_us, l.event_id) AS rn FROM (SELECT * FROM lagrows WHERE lag_s > 5.0) l
 ASOF LEFT JOIN (SELECT ts_us FROM acts WHERE action = 'unfreeze_adaptation') r ON l.ts_us >= r.ts_us) WHERE rn = 1"""
CTES["switches"] = "SELECT ts_us, action FROM acts WHERE action <> 'refresh_reference' UNION ALL SELECT ts_us, 'freeze_adaptation' FROM opened"
CTES["ticks2"] = "SELECT k.* EXCLUDE (frozen), coalesce(a.action = 'freeze_adaptation', FALSE) AS frozen FROM ticks1 k ASOF LEFT JOIN switches a ON k.ts_us >= a.ts_us"
CTES["path2"] = _path("ticks2", CC)
RAW["t9_controlled_run"] = "SELECT t, round(thr, 6) AS threshold, thr <> old AS changed FROM path2 WHERE i > 0"
CTES["refreshes"] = f"""SELECT at_u, row_number() OVER (ORDER BY at_u) AS profile_id, lead(at_u) OVER (ORDER BY at_u) AS to_u FROM (
 SELECT DISTINCT at_u FROM (SELECT a.ts_us, max(s.t - {DC.reference_events}) AS at_u FROM acts a JOIN scored s ON s.ts_us <= a.ts_us AND s.t > {DC.reference_events} WHERE a.action = 'refresh_reference' GROUP BY 1) WHERE at_u >= {DC.min_samples})"""
_KEPT = min(DC.window_size, DC.reference_events)
CTES["versions"] = """SELECT 0::BIGINT AS profile_id, 0::BIGINT AS from_u, (SELECT min(at_u) FROM refreshes) AS to_u UNION ALL SELECT profile_id, at_u, to_u FROM refreshes"""
CTES["vlongs"] = f"""SELECT 0::BIGINT AS profile_id, feature, value FROM longs WHERE t <= {DC.reference_events}
 UNION ALL SELECT r.profile_id, l.feature, l.value FROM refreshes r JOIN longs l ON l.t - {DC.reference_events} <= r.at_u AND l.t - {DC.reference_events} > r.at_u - {_KEPT} AND l.t > {DC.reference_events}"""
CTES["vprof"] = """SELECT profile_id, feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) + 1e-9 AS std,
 list_concat(list_concat([min(value) - 1e-9], quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])), [max(value) + 1e-9]) AS edges FROM vlongs GROUP BY profile_id, feature"""
CTES["vrefshare"] = f"""SELECT p.profile_id, p.feature, b.bin, least(greatest(coalesce(c.c, 0) / p.n::DOUBLE, 1e-6), 1.0) AS r FROM vprof p CROSS JOIN bins10 b
 LEFT JOIN (SELECT l.profile_id, l.feature, {_bin('l.value', 'p.edges')} AS bin, count(*) AS c FROM vlongs l JOIN vprof p ON p.profile_id = l.profile_id AND p.feature = l.feature GROUP BY ALL) c
 ON c.profile_id = p.profile_id AND c.feature = p.feature AND c.bin = b.bin"""
CTES["vticks"] = "SELECT e.u, v.profile_id FROM evalticks e JOIN versions v ON e.u > v.from_u AND (v.to_u IS NULL OR e.u <= v.to_u)"
CTES["vbinned"] = f"""SELECT e.u, e.profile_id, l.feature, {_bin('l.value', 'p.edges')} AS bin, count(*) AS c, sum(l.value) AS s
 FROM vticks e JOIN longs l ON l.t - {DC.reference_events} > e.u - {DC.window_size} AND l.t - {DC.reference_events} <= e.u AND l.t > {DC.reference_events}
 JOIN vprof p ON p.profile_id = e.profile_id AND p.feature = l.feature GROUP BY ALL"""
CTES["vtotals"] = "SELECT u, profile_id, feature, sum(c) FILTER (bin > 0) AS inside, sum(c) AS n_cur, sum(s) AS s FROM vbinned GROUP BY ALL"
CTES["vshare"] = """SELECT t.u, t.profile_id, t.feature, r.bin, r.r, coalesce(c.c, 0)::DOUBLE / greatest(1, coalesce(t.inside, 0)) AS raw
 FROM vtotals t JOIN vrefshare r ON r.profile_id = t.profile_id AND r.feature = t.feature LEFT JOIN vbinned c ON c.u = t.u AND c.feature = t.feature AND c.bin = r.bin"""
CTES["vcum"] = "SELECT *, abs(sum(r) OVER w - sum(raw) OVER w) AS gap FROM vshare WINDOW w AS (PARTITION BY u, feature ORDER BY bin)"
CTES["vdist"] = """SELECT t.u, t.profile_id, t.feature, t.n_cur::BIGINT AS n_cur, d.psi, d.ks, sqrt(-0.5 * ln(0.0005)) * sqrt((p.n + t.n_cur) / (p.n * t.n_cur)::DOUBLE) AS ks_critical,
  abs(t.s / t.n_cur - p.mean) / greatest(1e-9, p.std) AS mean_shift_z
 FROM vtotals t JOIN vprof p ON p.profile_id = t.profile_id AND p.feature = t.feature JOIN (
  SELECT u, feature, sum((least(greatest(raw, 1e-6), 1.0) - r) * ln(least(greatest(raw, 1e-6), 1.0) / r)) AS psi, max(gap) AS ks FROM vcum GROUP BY u, feature) d ON d.u = t.u AND d.feature = t.feature"""
CTES["evrows2"] = CTES["evrows"].replace("FROM dist ", "FROM vdist ")
CTES["states2"] = _fold(False, True, DC.critical_consecutive).replace("evrows", "evrows2")
CTES["ticks3"] = f"""SELECT row_number() OVER (ORDER BY k.t) AS i, k.t, k.ts_us, k.event_id, k.q, k.n_history AS n, 0.0 AS om, 0.0 AS um, coalesce(s.con, FALSE) AS drift, coalesce(a.action = 'freeze_adaptation', FALSE) AS frozen
 FROM tickq k ASOF LEFT JOIN (SELECT ts_us, action FROM acts WHERE action <> 'refresh_reference') a ON k.ts_us >= a.ts_us LEFT JOIN states2 s ON s.i > 0 AND s.u = k.t - {DC.reference_events}"""
CTES["path3"] = _path("ticks3", CC)
RAW["t9_refreshed_profiles"] = """SELECT v.profile_id, p.feature, v.from_u, coalesce(v.to_u, -1) AS to_u, round(p.edges[6], 5) AS mid_edge, p.n, round(p.mean, 5) AS mean, round(p.std, 5) AS std
FROM versions v JOIN vprof p ON p.profile_id = v.profile_id"""
RAW["t9_refreshed_distances"] = "SELECT u, profile_id, feature, n_cur, round(psi, 5) AS psi, round(ks, 5) AS ks, round(mean_shift_z, 5) AS mean_shift_z FROM vdist"
RAW["t9_refreshed_states"] = """SELECT s.u, t.profile_id, round(s.score, 5) AS drift_score, round(s.lim, 5) AS drift_threshold, round(s.vote, 5) AS vote_ratio, s.won AS drift_warning_active, s.con AS drift_active
FROM states2 s JOIN vticks t ON t.u = s.u WHERE s.i > 0"""
RAW["t9_refreshed_thresholds"] = "SELECT t, round(thr, 6) AS threshold, thr <> old AS changed FROM path3 WHERE i > 0"
RAW["s1_line_files"] = RAW["s1_jsonl_replay"]
RAW["s2_dump_stream"] = RAW["s2_parse_broker_values"]
RAW["t2_t3_drift_states_chunked"] = RAW["t2_t3_drift_states"]
RAW["t5_threshold_path_chunked"] = RAW["t5_threshold_path"]
RAW["s3_commit_after_processing"] = "SELECT event_id, count(*) AS arrivals, round(sum(amount), 6) AS amount FROM copies GROUP BY event_id"
RAW["st1_stream_features"] = RAW["w1_entity_features"]
RAW["st2_stream_dedupe"] = "SELECT event_id, entity_id, merchant_id, country, channel FROM ev"
RAW["st3_micro_batches"] = "SELECT t, round(thr, 6) AS threshold, thr <> old AS changed, round(thr, 6) AS in_batches, thr <> old AS changed_in_batches FROM path1 WHERE i > 0"
RAW["st4_state_after_restart"] = """SELECT 'main' AS stream_id, round(p.thr, 5) AS threshold, p.cus AS changed_us, round(p.lg, 5) AS logged, p.lus AS logged_us, len(s.scores)::BIGINT AS learned, round(list_sum(s.scores), 5) AS score_sum, s.won AS warning, s.con AS critical
FROM (SELECT * FROM path1 ORDER BY i DESC LIMIT 1) p, (SELECT * FROM states ORDER BY i DESC LIMIT 1) s"""
RAW["st6_stream_decisions"] = "SELECT u, round(score, 5) AS drift_score, round(lim, 5) AS drift_threshold, round(vote, 5) AS vote_ratio, won AS drift_warning_active, con AS drift_active FROM states WHERE i > 0"
RAW["st6_stream_thresholds"] = "SELECT t, round(thr, 6) AS threshold, thr <> old AS changed FROM path1 WHERE i > 0"
RAW["st6_controlled_decisions"] = RAW["t9_refreshed_states"]
RAW["st6_controlled_thresholds"] = RAW["t9_refreshed_thresholds"]
# Adaptive windowing in single steps: a block is appended (phase 0), full levels are merged (1), old buckets are dropped
# while some cut of the window is significant (2). Lists hold levels, sizes, means and squared deviations, oldest first.
CTES["blocks"] = f"""SELECT block, t, n, mean, squares, row_number() OVER (ORDER BY block) AS i FROM (SELECT block, block * {DC.adwin_clock} + {DC.reference_events} AS t, count(*)::DOUBLE AS n, avg(score) AS mean, var_pop(score) * count(*) AS squares
 FROM (SELECT score, CAST(ceil((t - {DC.reference_events}) / {float(DC.adwin_clock)!r}) AS BIGINT) AS block FROM scored WHERE t > {DC.reference_events}) GROUP BY block) WHERE n = {DC.adwin_clock}"""


def _spliced(column: str, new: str) -> str:
    return f"list_concat(list_concat({column}[1:p - 1], [{new}]), {column}[p + 2:])"


_GAP = "(m[p + 1] - m[p])"
_PAIR = "(n[p] + n[p + 1])"
CTES["adwin"] = f"""
 SELECT 0::BIGINT AS i, 0::BIGINT AS t, 0 AS phase, 0 AS l, []::INT[] AS lv, []::DOUBLE[] AS n, []::DOUBLE[] AS m, []::DOUBLE[] AS q, FALSE AS changed
 UNION ALL SELECT * FROM (
 SELECT b.i, b.t, 1 AS phase, 0 AS l, list_append(s.lv, 0), list_append(s.n, b.n), list_append(s.m, b.mean), list_append(s.q, b.squares), FALSE FROM @self s JOIN blocks b ON s.phase = 0 AND b.i = s.i + 1
 UNION ALL
 SELECT i, t, CASE WHEN crowded THEN 1 ELSE 2 END, CASE WHEN crowded THEN l + 1 ELSE l END, CASE WHEN crowded THEN {_spliced('lv', 'l + 1')} ELSE lv END, CASE WHEN crowded THEN {_spliced('n', _PAIR)} ELSE n END,
  CASE WHEN crowded THEN {_spliced('m', f'm[p] + {_GAP} * n[p + 1] / {_PAIR}')} ELSE m END, CASE WHEN crowded THEN {_spliced('q', f'q[p] + q[p + 1] + {_GAP} * {_GAP} * n[p] * n[p + 1] / {_PAIR}')} ELSE q END, changed
 FROM (SELECT *, len(list_filter(lv, lambda x: x = l)) > 5 AS crowded, list_position(lv, l) AS p FROM @self WHERE phase = 1)
 UNION ALL
 SELECT i, t, CASE WHEN cut THEN 2 ELSE 0 END, l, CASE WHEN cut THEN lv[2:] ELSE lv END, CASE WHEN cut THEN n[2:] ELSE n END, CASE WHEN cut THEN m[2:] ELSE m END, CASE WHEN cut THEN q[2:] ELSE q END, changed OR cut
 FROM (SELECT *, total > 10 AND len(list_filter(range(1, len(n)), lambda k: list_sum(n[1:k]) >= 5 AND total - list_sum(n[1:k]) >= 5 AND
   abs(list_sum(nm[1:k]) / list_sum(n[1:k]) - list_sum(nm[k + 1:]) / list_sum(n[k + 1:])) >
   sqrt(2.0 * (1.0 / list_sum(n[1:k]) + 1.0 / (total - list_sum(n[1:k]))) * variance * conf) + 2.0 / 3.0 * (1.0 / list_sum(n[1:k]) + 1.0 / (total - list_sum(n[1:k]))) * conf)) > 0 AS cut
  FROM (SELECT *, (list_sum(q) + list_sum(list_transform(range(1, len(n) + 1), lambda k: n[k] * (m[k] - mean) * (m[k] - mean)))) / total AS variance, ln(2.0 * ln(greatest(total, 1.1)) / {DC.adwin_delta!r}) AS conf
   FROM (SELECT *, list_sum(nm) / total AS mean FROM (SELECT *, list_sum(n) AS total, list_transform(range(1, len(n) + 1), lambda k: n[k] * m[k]) AS nm FROM @self WHERE phase = 2)))))"""
CTES["adflags"] = "SELECT t, changed, list_sum(n) AS total, list_sum(list_transform(range(1, len(n) + 1), lambda k: n[k] * m[k])) / list_sum(n) AS mean FROM adwin WHERE phase = 0 AND i > 0"
RAW["t4_adwin_flags"] = "SELECT t, changed AS adwin_detected, total::BIGINT AS window_rows, round(mean, 6) AS window_mean FROM adflags"
CTES["evrows3"] = f"SELECT e.*, coalesce(a.changed, FALSE) AS ad FROM evrows e LEFT JOIN adflags a ON a.t = e.u + {DC.reference_events}"
CTES["states3"] = _fold(False, True, DC.critical_consecutive).replace("evrows", "evrows3").replace("e.sk, p.scores", "e.sk, e.ad, p.scores").replace("END AS whit", "END OR (ad AND vote >= 0.2 * 0.8) AS whit")
RAW["c1_evaluations_with_adwin"] = """SELECT s.u, round(s.score, 5) AS drift_score, e.ad AS adwin_detected, s.won AS drift_warning_active, s.con AS drift_active FROM states3 s JOIN evrows3 e ON e.i = s.i WHERE s.i > 0"""
# Isolation forest, level by level: trees grown from drawn numbers, then rows walk them.
_M = I.CONFIG.model
_PSI = min(_M.subsample, _M.warmup_events)
_DEPTH = max(1, math.ceil(math.log2(max(_PSI, 2))))


def _draw(*parts: str) -> str:
    return f"(('0x' || substr(md5({_M.seed} || '|' || " + " || '|' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _path_length(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} <= 2 THEN 1.0::DOUBLE ELSE 2.0 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0 * ({n} - 1.0) / {n} END)"


CTES["xrows"] = "SELECT event_id, idx, [" + ", ".join(_guard(f) for f in FEATURES) + "] AS x FROM feat"
CTES["grow0"] = f"""SELECT tree, 1::BIGINT AS node, x FROM (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY {_draw('tree', 'idx')}, idx) AS place
 FROM xrows, (SELECT range AS tree FROM range({_M.n_trees})) WHERE idx <= {_M.warmup_events}) WHERE place <= {_PSI}"""
for _d in range(_DEPTH + 1):
    CTES[f"node{_d}"] = f"""SELECT tree, node, n, CASE WHEN {'TRUE' if _d == _DEPTH else 'FALSE'} OR n <= 1 OR len(usable) = 0 THEN 0 ELSE usable[CAST(floor({_draw('tree', 'node', "'feature'")} * len(usable)) AS BIGINT) + 1] END AS f, lo, hi
 FROM (SELECT *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: hi[i] > lo[i]) AS usable FROM (SELECT tree, node, count(*) AS n, [{', '.join(f'min(x[{i}])' for i in range(1, len(FEATURES) + 1))}] AS lo, [{', '.join(f'max(x[{i}])' for i in range(1, len(FEATURES) + 1))}] AS hi FROM grow{_d} GROUP BY tree, node))"""
    CTES[f"cut{_d}"] = f"SELECT tree, node, f, CASE WHEN f > 0 THEN lo[f] + {_draw('tree', 'node', chr(39) + 'split' + chr(39))} * (hi[f] - lo[f]) END AS at, {_d} + {_path_length('n')} AS path FROM node{_d}"
    if _d < _DEPTH:
        CTES[f"grow{_d + 1}"] = f"SELECT g.tree, 2 * g.node + (CASE WHEN g.x[c.f] <= c.at THEN 0 ELSE 1 END) AS node, g.x FROM grow{_d} g JOIN cut{_d} c ON c.tree = g.tree AND c.node = g.node WHERE c.f > 0"
    _from = "(SELECT event_id, x, tree, 1::BIGINT AS node FROM xrows, (SELECT range AS tree FROM range(%d)))" % _M.n_trees if _d == 0 else f"walk{_d - 1}"
    CTES[f"walk{_d}"] = f"""SELECT w.event_id, w.x, w.tree, CASE WHEN c.f > 0 THEN 2 * w.node + (CASE WHEN w.x[c.f] <= c.at THEN 0 ELSE 1 END) ELSE -1 END AS node, CASE WHEN w.node < 0 THEN {'NULL' if _d == 0 else 'w.path'} WHEN c.f = 0 THEN c.path END AS path
 FROM {_from} w LEFT JOIN cut{_d} c ON c.tree = w.tree AND c.node = w.node"""
CTES["forest"] = f"SELECT event_id, idx, pow(2.0, -(avg(path)) / {_path_length(str(_PSI))}) AS raw_score FROM walk{_DEPTH} JOIN xrows USING (event_id) GROUP BY event_id, idx"
RAW["m2_isolation_forest"] = f"""SELECT event_id, round(raw_score, 6) AS raw_score, round(1.0 / (1.0 + exp(-(raw_score - mu) / (sd + 1e-9))), 6) AS score FROM forest,
 (SELECT avg(raw_score) AS mu, CASE WHEN stddev_pop(raw_score) = 0 THEN 1.0 ELSE stddev_pop(raw_score) END AS sd FROM forest WHERE idx <= {_M.warmup_events}) WHERE idx > {_M.warmup_events}"""
RAW["w13_running_quality"] = """SELECT u, tp::BIGINT AS run_tp, fp::BIGINT AS run_fp, tr::BIGINT AS run_true, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END, 6) AS run_precision, round(CASE WHEN tr > 0 THEN tp / tr::DOUBLE ELSE 0.0 END, 6) AS run_recall
FROM (SELECT u, count(*) FILTER (con AND drift_tag IS NOT NULL) OVER w AS tp, count(*) FILTER (con AND drift_tag IS NULL) OVER w AS fp, count(*) FILTER (drift_tag IS NOT NULL) OVER w AS tr FROM stateout WINDOW w AS (ORDER BY u))"""
RAW["a28_state_summary"] = f"""SELECT 'main' AS stream_id, count(*) AS scored_events, max_by(con, t) AS drift_active, max_by(won, t) AS drift_warning_active, round(max_by(ds, t), 6) AS drift_score, round(max_by(thr, t), 6) AS threshold,
 round((SELECT avg((s.score >= e.th)::INT) FROM scored s, (SELECT max(t) AS mt, max_by(thr, t) AS th FROM judged) e WHERE s.t > e.mt - {CC.history}), 6) AS recent_rate FROM judged"""
RAW["a28_state_summary"] = f"""SELECT * REPLACE (round(recent_rate, 6) AS recent_rate) FROM ({RAW['a28_state_summary']}),
 (SELECT true AS model_ready, round(quantile_cont(lag_s, 0.5), 6) AS lag_p50_s, round(quantile_cont(lag_s, 0.95), 6) AS lag_p95_s, round(max(lag_s), 6) AS lag_max_s FROM lagrows),
 (SELECT count(*) - count(DISTINCT event_id) AS duplicates FROM copies),
 (SELECT action = '{control.FREEZE}' AS frozen, CASE WHEN action = '{control.FREEZE}' THEN coalesce(reason, 'manual_freeze') END AS freeze_reason
  FROM acts WHERE action IN ('{control.FREEZE}', '{control.UNFREEZE}') ORDER BY ts_us DESC, action DESC, coalesce(reason, 'manual') DESC LIMIT 1)"""
RAW["c1_scored_output"] = """SELECT event_id, 'scored' AS status, round(score, 5) AS score, round(thr, 5) AS threshold, is_anomaly, evaluated AS drift_evaluated, con AS drift_active, won AS drift_warning_active, round(ds, 5) AS drift_score, round(vr, 5) AS vote_ratio FROM judged
UNION ALL SELECT event_id, 'warming_up', NULL, NULL, FALSE, FALSE, FALSE, FALSE, NULL, NULL FROM feat WHERE idx <= 1500"""
RAW["c1_alerts"] = "SELECT event_id, ts_us, round(thr, 5) AS threshold, CASE WHEN score >= least(0.99, thr + 0.10) THEN 'high' WHEN score >= least(0.95, thr + 0.05) THEN 'medium' ELSE 'low' END AS severity, round(ds, 5) AS drift_score FROM judged WHERE is_anomaly"
RAW["st5_stream_alerts"] = RAW["c1_alerts"].replace(", round(ds, 5) AS drift_score", "")
_SEV = "CASE WHEN score >= least(0.99, thr + 0.10) THEN 'high' WHEN score >= least(0.95, thr + 0.05) THEN 'medium' ELSE 'low' END"


def _filled(metric: str, label: str, values, count: str) -> str:
    """Rows of one counter, ``count`` being a scalar that may use the value ``v``."""
    return f"SELECT '{metric}' AS metric, '{label}' AS label, v AS value, {count} AS count FROM (SELECT unnest({_list(values)}) AS v)"


def _total(metric: str, count: str) -> str:
    return f"SELECT '{metric}', '', '', {count}"


RAW["a23_operational_counters"] = " UNION ALL ".join([
    _filled("events_ingested_total", "source", ops.SOURCES, "(SELECT count(*) FROM copies WHERE source = v)"),
    _filled("duplicate_events_total", "source", ops.SOURCES, "(SELECT count(*) - count(DISTINCT event_id) FROM copies WHERE source = v)"),
    _filled("deserialize_errors_total", "source", ops.DESERIALIZE_SOURCES, f"CASE WHEN v = 'kafka' THEN (SELECT sum(n)::BIGINT FROM ({RAW['s2_parse_broker_values']}) WHERE outcome = 'dead_letter') ELSE 0 END"),
    _filled("alerts_emitted_total", "severity", ops.SEVERITIES, f"(SELECT count(*) FROM judged WHERE is_anomaly AND {_SEV} = v)"),
    _filled("admin_actions_total", "action", (control.FREEZE, control.UNFREEZE, control.REFRESH), "(SELECT count(*) FROM acts WHERE action = v)"),
    _filled("errors_total", "component", ops.ERROR_COMPONENTS, "0::BIGINT"),
    _total("events_scored_total", "(SELECT count(*) FROM scored)"),
    _total("drift_alert_total", "(SELECT count(*) FROM stateout)"),
    _total("drift_alert_positive_total", "(SELECT count(*) FILTER (con) FROM stateout)"),
    _total("drift_alert_fixed_positive_total", "(SELECT count(*) FILTER (fixed) FROM stateout)"),
    _total("drift_true_label_total", "(SELECT count(*) FILTER (drift_tag IS NOT NULL) FROM stateout)"),
    _total("drift_true_positive_total", "(SELECT count(*) FILTER (con AND drift_tag IS NOT NULL) FROM stateout)"),
    _total("drift_false_positive_total", "(SELECT count(*) FILTER (con AND drift_tag IS NULL) FROM stateout)"),
])


def _histogram(name: str, table: str, value: str, edges) -> str:
    rows = " UNION ALL ".join(f"SELECT '{e}' AS le, (SELECT count(*) FROM {table} WHERE {value} <= {e}) AS bucket" for e in edges)
    return f"SELECT '{name}' AS histogram, le, bucket, round((SELECT sum({value}) FROM {table}), 4) AS total FROM ({rows} UNION ALL SELECT '+Inf', (SELECT count(*) FROM {table}))"


RAW["a24_latency_histograms"] = _histogram("score_latency_seconds", "okreq", "(latency_ms / 1000.0::DOUBLE)", ops.SCORE_LATENCY_EDGES) + " UNION ALL " + _histogram("processing_lag_seconds", "lagrows", "lag_s", ops.LAG_EDGES)
RAW["t8_circuit_alerts"] = """SELECT substr(sha256('lag_circuit|main|' || ts_us || '|'), 1, 24) AS alert_id, ts_us, 'system' AS entity_id, 'critical' AS severity, 'processing_lag_threshold_exceeded' AS reason, lag_s AS processing_lag_seconds
FROM (""" + RAW["t8_lag_circuit"] + ")"
RAW["c5_replay_confusion"] = f"""SELECT points, tp, fp, fn, tn, {_rates()} FROM (SELECT count(*) AS points, {_confusion('truth', 'pred')} FROM (
 SELECT f.drift_tag IS NOT NULL AS truth, coalesce(s.con, FALSE) AS pred FROM feat f LEFT JOIN states s ON s.i > 0 AND s.u = f.idx - 1500 - {DC.reference_events}))"""
RAW["c5_replay_summary"] = """SELECT (SELECT count(*) FROM feat) AS events_total, count(*) AS events_scored, count(*) FILTER (is_anomaly) AS alerts, count(*) FILTER (is_anomaly AND drift_tag IS NULL) AS false_alerts,
 round(CASE WHEN count(*) FILTER (is_anomaly) > 0 THEN count(*) FILTER (is_anomaly AND drift_tag IS NULL) / count(*) FILTER (is_anomaly)::DOUBLE ELSE 0.0 END, 3) AS false_alert_rate,
 (min(idx) FILTER (con AND idx >= o) - any_value(o))::BIGINT AS events_to_detect, round((min(ts_us) FILTER (con AND idx >= o) - any_value(os)) / 1e6, 3) AS seconds_to_detect
FROM judged, (SELECT min(idx) FILTER (drift_tag IS NOT NULL) AS o, min(ts_us) FILTER (drift_tag IS NOT NULL) AS os FROM judged)"""
CTES["passes"] = f"""SELECT 'baseline' AS pass, t, score >= {CC.initial_threshold} AS hit, drift_tag IS NOT NULL AS drift, con FROM judged UNION ALL SELECT 'tuned', t, is_anomaly, drift_tag IS NOT NULL, con FROM judged"""
CTES["passsum"] = """SELECT pass, count(*) FILTER (hit) AS alerts, count(*) FILTER (hit AND NOT drift) AS fp, count(*) FILTER (hit) / count(*)::DOUBLE AS rate,
 CASE WHEN count(*) FILTER (con) > 0 AND count(*) FILTER (drift) > 0 THEN greatest(0, min(t) FILTER (con) - min(t) FILTER (drift)) END::BIGINT AS delay FROM passes GROUP BY pass"""
RAW["c4_compare_passes"] = """SELECT b.alerts AS baseline_alerts, n.alerts AS tuned_alerts, b.fp AS baseline_fp, n.fp AS tuned_fp, round(b.rate, 6) AS baseline_rate, round(n.rate, 6) AS tuned_rate, b.delay AS baseline_delay, n.delay AS tuned_delay, blocked AS guardrail_blocked,
 CASE WHEN b.alerts >= 50 AND n.alerts >= 50 THEN round(CASE WHEN b.fp > 0 THEN (b.fp - n.fp) / b.fp::DOUBLE * 100.0 ELSE 0.0 END, 6) END AS fp_reduction, round(n.rate - b.rate, 6) AS rate_change, n.delay - b.delay AS delay_change,
 n.rate <= 0.05 AS hard_limit_passed, abs(n.rate - 0.01) <= 0.005 OR blocked AS target_passed
FROM (SELECT * FROM passsum WHERE pass = 'baseline') b, (SELECT * FROM passsum WHERE pass = 'tuned') n, (SELECT count(*) FILTER (bnd) > 0 OR count(*) FILTER (stp) > 0 AS blocked FROM path1 WHERE i > 0)"""
CTES["drun"] = "SELECT row_number() OVER (ORDER BY u) AS idx, ts_us, CASE WHEN drift_tag IS NOT NULL THEN 1 ELSE 0 END AS ground_truth_drift, fixed::INT AS fixed_alert, con::INT AS critical_alert FROM stateout"
CTES["drunseg_f"] = _segments("drun", "idx", "ts_us", "ground_truth_drift", "fixed_alert")
CTES["drunseg_c"] = _segments("drun", "idx", "ts_us", "ground_truth_drift", "critical_alert")
RAW["c3_scoring_run_evaluation"] = RAW["c3_run_evaluation"].replace("runseg_f", "drunseg_f").replace("runseg_c", "drunseg_c").replace("FROM runreq", "FROM drun")
CTES["grid"] = """SELECT (e.i * 18 + v.i * 3 + c.i)::BIGINT AS param_id, e.x AS ce, v.x AS cv, c.x AS cc FROM (SELECT unnest([0, 1, 2]) AS i, unnest([0.8, 1.0, 1.2]::DOUBLE[]) AS x) e,
 (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([0.35, 0.40, 0.45, 0.50, 0.55, 0.60]::DOUBLE[]) AS x) v, (SELECT unnest([0, 1, 2]) AS i, unnest([1, 2, 3]) AS x) c"""
CTES["foldrows"] = """SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pos) - 1 AS ap FROM (SELECT (CASE WHEN train THEN (pos - 1) % folds ELSE -1 END)::BIGINT AS fold, pos, score, threshold::DOUBLE AS lim, vote_ratio::DOUBLE AS vote, ground_truth_drift AS y FROM splitrows)"""
CTES["sim"] = """
 SELECT f.fold, g.param_id, -1::BIGINT AS ap, 0 AS y, FALSE AS won, FALSE AS con, 0 AS wrun, 0 AS crun, -1000000000::BIGINT AS last, g.ce, g.cv, g.cc FROM (SELECT DISTINCT fold FROM foldrows) f, grid g
 UNION ALL
 SELECT fold, param_id, ap, y, won2, (con AND chit) OR (crun2 >= cc AND ap - last >= 2), CASE WHEN whit THEN wrun + 1 ELSE 0 END, crun2, CASE WHEN NOT (con AND chit) AND crun2 >= cc AND ap - last >= 2 THEN ap ELSE last END, ce, cv, cc
 FROM (SELECT *, CASE WHEN chit THEN crun + 1 ELSE 0 END AS crun2 FROM (SELECT *, CASE WHEN con THEN score >= lim * 0.8::DOUBLE AND vote >= cv * 0.8::DOUBLE ELSE won2 AND score >= lim * ce AND vote >= cv END AS chit
  FROM (SELECT *, whit AS won2 FROM (SELECT r.fold, p.param_id, r.ap, r.y, p.won, p.con, p.wrun, p.crun, p.last, p.ce, p.cv, p.cc, r.score, r.lim, r.vote,
   CASE WHEN p.won THEN r.score >= r.lim * 0.6::DOUBLE AND r.vote >= 0.2::DOUBLE * 0.8::DOUBLE ELSE r.score >= r.lim * 0.8::DOUBLE AND r.vote >= 0.2::DOUBLE END AS whit FROM @self p JOIN foldrows r ON r.fold = p.fold AND r.ap = p.ap + 1))))"""
CTES["simconf"] = f"SELECT fold, param_id, {_confusion('y = 1', 'con')} FROM sim WHERE ap >= 0 GROUP BY ALL"
RAW["t10_replay"] = "SELECT fold, param_id, tp, fp, tn, fn FROM simconf"
CTES["simrates"] = """SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r,
 CASE WHEN tp + fp > 0 THEN fp::DOUBLE / (tp + fp) ELSE 0.0 END AS far FROM simconf)"""
CTES["cvmeans"] = """SELECT param_id, avg(p) AS p, avg(r) AS r, avg(f) AS f, avg(far) AS far, avg(o) - 0.2 * stddev_pop(o) AS obj FROM (SELECT *, f - 3.0 * greatest(0.0, far - 0.2) - 2.0 * greatest(0.0, 0.75 - p) - 2.0 * greatest(0.0, 0.8 - r) AS o FROM simrates WHERE fold >= 0) GROUP BY param_id"""
RAW["t11_cross_validation"] = "SELECT param_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(far, 6) AS false_alert_rate, round(obj, 6) AS objective FROM cvmeans"
RAW["c6_threshold_sweep"] = """SELECT row_number() OVER (ORDER BY c.obj DESC, c.param_id) AS place, c.param_id, g.ce AS critical_enter, g.cv AS critical_vote, g.cc::BIGINT AS critical_consecutive, round(c.obj, 6) AS objective, round(c.p, 6) AS precision, round(c.r, 6) AS recall, round(c.f, 6) AS f1,
 round(h.p, 6) AS holdout_precision, round(h.r, 6) AS holdout_recall FROM cvmeans c JOIN grid g USING (param_id) JOIN (SELECT * FROM simrates WHERE fold = -1) h USING (param_id) ORDER BY place LIMIT 5"""

RAW["s12_run_document"] = f"""SELECT d.detector, d.tp, d.fp, d.fn, d.tn, d.precision, d.recall, s.requests_total, s.latency_p95_ms, l.checked_rows, l.mismatches, l.valid, (SELECT count(DISTINCT phase) FROM runreq) AS phases
FROM ({RAW['c3_run_evaluation']}) d, ({RAW['c3_run_summary']}) s, ({RAW['c3_run_labels']}) l"""
RAW["s12_sweep_document"] = RAW["c6_threshold_sweep"]
RAW["s12_report_document"] = f"SELECT r.*, (SELECT count(*) FROM b_alerts) AS windows, (SELECT min(start_us) FROM b_alerts) AS first_us FROM ({RAW['c2_drift_report']}) r"

ORACLE: dict[str, str] = {name: compose(sql) for name, sql in RAW.items()}
