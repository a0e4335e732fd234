"""Aggregations, narratives, evaluation, rules and behavioural baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.numeric import round_to
from wardline.catalog.basics import ACTION, BAND, CONTENT, HASH, SCORE
from wardline.catalog.registry import Inputs, day_text, query
from wardline.functions import scoring, text
from wardline.operators import (
    attribution, baselines, evaluate, feedback, forest, profile, rules, triage, windows,
)
from wardline.schemas import FEATURES

col = F.col


def _per_feature(measures: str, features=FEATURES) -> str:
    """UNION ALL of one SELECT per feature; {f} stands for the feature."""
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {measures.format(f=f)} FROM fe" for f in features)


# --- aggregations ------------------------------------------------------------------------


@query("a1_feature_ranges", _per_feature(
    "min({f}) AS min_value, max({f}) AS max_value, count(CASE WHEN {f} <> 0 THEN 1 END) AS nonzero, count({f}) AS total"))
def feature_ranges(q: Inputs):
    return profile.feature_ranges(q.stored, FEATURES)


_R3 = "round_even(CAST({} AS DOUBLE), 3) AS {}"


@query("a2_describe", _per_feature(
    "count({f}) AS count, " + ", ".join(
        _R3.format(expr, name) for expr, name in [
            ("avg({f})", "mean"), ("stddev_samp({f})", "std"), ("min({f})", "min"),
            ("quantile_cont({f}, 0.25)", "p25"), ("quantile_cont({f}, 0.5)", "p50"),
            ("quantile_cont({f}, 0.75)", "p75"), ("max({f})", "max")])))
def describe(q: Inputs):
    return profile.describe(q.stored, FEATURES)


@query("a3_score_summary", """
SELECT min(anomaly_score) AS min_score, max(anomaly_score) AS max_score, round_even(avg(anomaly_score), 6) AS mean_score,
  round_even(stddev_pop(anomaly_score), 6) AS std_score, count(CASE WHEN prediction = -1 THEN 1 END) AS anomalies,
  count(*) AS total, round_even(avg(CASE WHEN prediction = -1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM rp""")
def score_summary(q: Inputs):
    out = profile.score_summary(q.rule_scored)
    return out.withColumns({c: round_to(c, 6) for c in ["mean_score", "std_score", "share"]})


@query("a4_counts_by", """
SELECT 'anomaly_type' AS dimension, anomaly_type AS value, count(*) AS n FROM fx_labels GROUP BY ALL
UNION ALL SELECT 'department', department, count(*) FROM fx_labels GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM fx_labels GROUP BY ALL""")
def counts_by(q: Inputs):
    return profile.counts_by(q.typed, ["anomaly_type", "department", "severity"])


@query("a5_user_conditions", """
SELECT count(CASE WHEN notice_period THEN 1 END) AS on_notice, count(CASE WHEN failed_logins_30d >= 5 THEN 1 END) AS many_failed_logins,
  count(CASE WHEN vpn_user THEN 1 END) AS vpn_users, count(CASE WHEN NOT security_training_current THEN 1 END) AS training_missing
FROM fx_profiles""")
def user_conditions(q: Inputs):
    return profile.user_conditions(q.profiles)


@query("a5_event_conditions", """
SELECT count(CASE WHEN destination IN ('external_email','usb_drive','cloud_storage','personal_device') THEN 1 END) AS external_dest,
  count(CASE WHEN NOT starts_with(source_ip, '10.') THEN 1 END) AS external_ip,
  count(CASE WHEN geo_location IN ('Unknown_VPN','Tor_Exit_Node','Lagos','Pyongyang','Caracas') THEN 1 END) AS suspicious_geo
FROM fx_logs""")
def event_conditions(q: Inputs):
    return profile.event_conditions(q.logs)


@query("a6_shares", """
SELECT 'users' AS of_what, count(*) AS total, count(CASE WHEN high_risk_flag THEN 1 END) AS flagged,
  round_even(avg(CASE WHEN high_risk_flag THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM fx_profiles
UNION ALL SELECT 'events', count(*), count(CASE WHEN is_anomaly THEN 1 END),
  round_even(avg(CASE WHEN is_anomaly THEN 1.0::DOUBLE ELSE 0 END), 6) FROM fx_labels""")
def shares(q: Inputs):
    part = lambda df, flag, name: profile.share(df, col(flag)).select(
        F.lit(name).alias("of_what"), "total", "flagged", round_to("share", 6).alias("share")
    )
    return part(q.profiles, "high_risk_flag", "users").unionByName(part(q.labels, "is_anomaly", "events"))


@query("a7_severity_counts", """
SELECT severity, count(*) AS n FROM fx_labels GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM fx_labels""")
def severity_counts(q: Inputs):
    return profile.severity_counts(q.labels)


@query("a8_cross_tab", """
SELECT query_type, count(CASE WHEN data_sensitivity = 'low' THEN 1 END) AS low,
  count(CASE WHEN data_sensitivity = 'medium' THEN 1 END) AS medium, count(CASE WHEN data_sensitivity = 'high' THEN 1 END) AS high,
  count(CASE WHEN data_sensitivity = 'restricted' THEN 1 END) AS restricted
FROM fx_logs GROUP BY 1""")
def cross_tab(q: Inputs):
    return profile.cross_tab(q.logs, "query_type", "data_sensitivity", ["low", "medium", "high", "restricted"])


@query("a9_hour_histogram", """
SELECT t AS time_classification, CAST(h AS INTEGER) AS hour, count(access_id) AS n
FROM (SELECT unnest(['business_hours', 'after_hours', 'night', 'weekend', 'early_morning']) AS t) CROSS JOIN (SELECT unnest(range(24)) AS h)
LEFT JOIN fx_logs ON time_classification = t AND hour(timestamp) = h GROUP BY 1, 2""")
def hour_histogram(q: Inputs):
    classes = ["business_hours", "after_hours", "night", "weekend", "early_morning"]
    return profile.hour_histogram(q.logs, classes)


def _histogram_sql(source: str, c: str, bins: int, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}'{c}' AS feature, CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT *, {c} AS x FROM {source}),
  (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
          CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi FROM {source}) GROUP BY ALL"""


@query("a10_feature_histograms", " UNION ALL ".join(_histogram_sql("fe", f, 30) for f in FEATURES))
def feature_histograms(q: Inputs):
    return profile.histograms(q.stored, FEATURES, 30)


@query("a10_score_histogram", _histogram_sql("rp", "anomaly_score", 50, "prediction"))
def score_histogram(q: Inputs):
    return profile.histograms(q.rule_scored, ["anomaly_score"], 50, ["prediction"])


@query("a11_importance", """
, imp AS (SELECT feature, avg(abs(shap_value)) AS v FROM pa GROUP BY 1)
SELECT feature, round_even(v, 6) AS importance, v > (SELECT median(v) FROM imp) AS above_median FROM imp""")
def importance(q: Inputs):
    ranked = attribution.global_importance(q.rule_explained)
    return ranked.withColumn("importance", round_to("importance", 6))


@query("a12_distinct_types", "SELECT DISTINCT anomaly_type FROM fx_labels WHERE is_anomaly")
def distinct_types(q: Inputs):
    return q.labels.where("is_anomaly").select("anomaly_type").distinct()


# --- model arithmetic that SQL can check -------------------------------------------------


@query("m1_standardise", "SELECT access_id, " + ", ".join(
    f"round_even(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END, 6) AS {f}"
    for f in FEATURES) + " FROM fe")
def standardise(q: Inputs):
    scaler = forest.fit_scaler(q.stored, FEATURES).collect()
    z = forest.standardise(q.stored, scaler, FEATURES)
    return z.select("access_id", *[round_to(f, 6).alias(f) for f in FEATURES])


@query("m4_quantile", _per_feature("round_even(CAST(quantile_cont({f}, 0.43) AS DOUBLE), 6) AS threshold"))
def quantile(q: Inputs):
    from wardline.operators.quantiles import exact_quantiles

    found = exact_quantiles(q.stored, FEATURES, [forest.CONTAMINATION])
    return found.select("feature", round_to("value", 6).alias("threshold"))


@query("m6_agreement", """
SELECT count(*) AS compared, count(CASE WHEN r.prediction = n.prediction THEN 1 END) AS equal,
  round_even(avg(CASE WHEN r.prediction = n.prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS match_rate
FROM rp r JOIN night n ON r.access_id = n.access_id""")
def agreement(q: Inputs):
    out = forest.agreement(q.rule_scored, rules.naive_night(q.logs))
    return out.withColumn("match_rate", round_to("match_rate", 6))


# --- narratives --------------------------------------------------------------------------


TOP_JOINED = """
, tj AS (
  SELECT t.access_id, max(CASE WHEN place = 1 THEN display_name END) AS n1, max(CASE WHEN place = 1 THEN description END) AS d1,
    max(CASE WHEN place = 2 THEN display_name END) AS n2, max(CASE WHEN place = 2 THEN description END) AS d2,
    max(CASE WHEN place = 3 THEN display_name END) AS n3, max(CASE WHEN place = 3 THEN description END) AS d3,
    max(CASE WHEN place = 1 THEN event_value END) AS v1, max(CASE WHEN place = 2 THEN event_value END) AS v2,
    max(CASE WHEN place = 3 THEN event_value END) AS v3
  FROM top3 t JOIN fd ON t.feature = fd.feature GROUP BY 1
)"""


def _explained_scores(q: Inputs):
    scores = q.rule_scored.select("access_id", "anomaly_score")
    slim = q.rule_explained.select(
        "access_id", "username", "department", "data_asset", "data_sensitivity", "timestamp", "attribution"
    )
    return slim.join(scores, "access_id").withColumn("top", attribution.top_features(col("attribution")))


@query("t2_narrative", f"""{TOP_JOINED}
SELECT r.access_id, upper(left({BAND}, 1)) || substr({BAND}, 2) || ' risk: ' || username || ' of ' || department || ' used '
  || replace(data_asset, '_', ' ') || ' (' || data_sensitivity || ' data) on ' || strftime(l.timestamp, '%d %b %Y at %H:%M')
  || '. Risk score ' || {SCORE} || ' of 100. Main factor: ' || n1 || ', ' || d1 || '. Also: ' || n2 || ', ' || d2 || '.' AS narrative
FROM rp r JOIN fx_logs l ON r.access_id = l.access_id JOIN tj ON r.access_id = tj.access_id""")
def narrative(q: Inputs):
    score = scoring.risk_score(col("anomaly_score"))
    when = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return _explained_scores(q).select(
        "access_id", triage.narrative(col("top"), score, when).alias("narrative")
    )


@query("t3_evidence", f"""{TOP_JOINED}
SELECT access_id, n1 || ': ' || d1 || '. ' || n2 || ': ' || d2 || '. ' || n3 || ': ' || d3 || '.' AS evidence,
  n1 || ' - ' || d1 || ' (observed ' || printf('%.4f', v1) || '); ' || n2 || ' - ' || d2 || ' (observed ' || printf('%.4f', v2)
  || '); ' || n3 || ' - ' || d3 || ' (observed ' || printf('%.4f', v3) || ')' AS with_values
FROM tj""")
def evidence(q: Inputs):
    top = attribution.top_features(col("attribution"))
    return q.rule_explained.withColumn("top", top).select(
        "access_id",
        F.array_join(triage.evidence(col("top")), " ").alias("evidence"),
        F.array_join(triage.evidence_with_values(col("top")), "; ").alias("with_values"),
    )


@query("t4_plain_narrative", f"""{TOP_JOINED}
SELECT r.access_id, CASE WHEN r.access_id % 3 = 0
  THEN 'Anomalous event with raw score ' || printf('%.4f', round_even(anomaly_score, 4)) || '. No factors are known.'
  ELSE 'Anomalous event with raw score ' || printf('%.4f', round_even(anomaly_score, 4)) || '. Main factor: ' || n1 || ', ' || d1 || '.' END AS narrative,
  {ACTION} AS action
FROM rp r JOIN tj ON r.access_id = tj.access_id""")
def plain_narrative(q: Inputs):
    known = F.when(col("access_id") % 3 != 0, col("top")).otherwise(F.slice("top", 1, 0))
    return _explained_scores(q).select(
        "access_id",
        triage.plain_narrative(known, col("anomaly_score")).alias("narrative"),
        scoring.recommended_action(col("anomaly_score")).alias("action"),
    )


@query("t5_reuse", f"""
, h AS (SELECT access_id, timestamp, {HASH} AS event_hash FROM fx_logs)
SELECT event_hash, epoch_us(timestamp) // 3600000000 AS ttl_cell, count(*) AS copies, min(access_id) AS access_id FROM h GROUP BY 1, 2""")
def reuse(q: Inputs):
    hashed = q.logs.withColumn("event_hash", text.content_hash(CONTENT))
    return triage.one_per_content(hashed, "event_hash", "timestamp", ["access_id"])


@query("t5_from_first_evaluation", """
, h AS (SELECT access_id, timestamp, sha256('department=' || coalesce(department, '\\N') || '|query_type=' || coalesce(query_type, '\\N')) AS event_hash FROM fx_logs),
s AS (WITH RECURSIVE r AS (
    SELECT event_hash, min(timestamp) AS t FROM h GROUP BY 1
    UNION ALL
    SELECT r.event_hash, min(h.timestamp) FROM r JOIN h ON h.event_hash = r.event_hash AND h.timestamp >= r.t + INTERVAL 1 HOUR GROUP BY 1)
  SELECT * FROM r),
e AS (SELECT h.event_hash, access_id, timestamp, max(s.t) AS t FROM h JOIN s ON s.event_hash = h.event_hash AND s.t <= h.timestamp GROUP BY 1, 2, 3)
SELECT event_hash, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS evaluated_at, min(access_id) FILTER (timestamp = t) AS access_id, count(*) AS copies
FROM e GROUP BY event_hash, t""")
def reuse_from_first(q: Inputs):
    """A result serves an hour from the event it was made for; busy contents chain without a pause."""
    hashed = q.logs.withColumn("event_hash", text.content_hash(["department", "query_type"]))
    out = triage.from_first_evaluation(hashed, "event_hash", "timestamp", "access_id")
    return out.withColumn("evaluated_at", F.date_format("evaluated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --- evaluation --------------------------------------------------------------------------

CONFUSION = """
, c AS (SELECT count(*) AS total, count(CASE WHEN predicted AND actual THEN 1 END) AS tp,
    count(CASE WHEN predicted AND NOT actual THEN 1 END) AS fp, count(CASE WHEN NOT predicted AND actual THEN 1 END) AS fn,
    count(CASE WHEN NOT predicted AND NOT actual THEN 1 END) AS tn FROM lp),
m AS (SELECT *, tp::DOUBLE / (tp + fp) AS p1, tp::DOUBLE / (tp + fn) AS r1, tn::DOUBLE / (tn + fn) AS p0, tn::DOUBLE / (tn + fp) AS r0 FROM c),
mm AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0, tp + fn AS s1, tn + fp AS s0 FROM m)"""


def _labelled(q: Inputs):
    return evaluate.labelled(rules.naive_night(q.logs), q.labels)


METRICS_SQL = f"""{CONFUSION}
SELECT total AS total_events, tp + fp AS total_predicted_anomalies, tp + fn AS total_ground_truth_anomalies,
  round_even(p1, 4) AS precision, round_even(r1, 4) AS recall, round_even(f1, 4) AS f1_score FROM mm"""


@query("e1_metrics", METRICS_SQL)
def metrics(q: Inputs):
    return evaluate.metrics(_labelled(q))


@query("e2_classification_report", f"""{CONFUSION}
SELECT 'Normal' AS class, round_even(p0, 4) AS precision, round_even(r0, 4) AS recall, round_even(f0, 4) AS f1_score, s0 AS support FROM mm
UNION ALL SELECT 'Anomaly', round_even(p1, 4), round_even(r1, 4), round_even(f1, 4), s1 FROM mm
UNION ALL SELECT 'accuracy', round_even((tp + tn)::DOUBLE / total, 4), round_even((tp + tn)::DOUBLE / total, 4),
  round_even((tp + tn)::DOUBLE / total, 4), total FROM mm
UNION ALL SELECT 'macro avg', round_even((p0 + p1) / 2, 4), round_even((r0 + r1) / 2, 4), round_even((f0 + f1) / 2, 4), total FROM mm
UNION ALL SELECT 'weighted avg', round_even((p0 * s0 + p1 * s1) / total, 4), round_even((r0 * s0 + r1 * s1) / total, 4),
  round_even((f0 * s0 + f1 * s1) / total, 4), total FROM mm""")
def classification_report(q: Inputs):
    return evaluate.classification_report(_labelled(q))


@query("e3_detection_by_type", """
SELECT anomaly_type, count(CASE WHEN predicted THEN 1 END) AS detected, count(*) AS total,
  round_even(avg(CASE WHEN predicted THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate,
  avg(CASE WHEN predicted THEN 1.0::DOUBLE ELSE 0 END) >= 0.7 AS good
FROM lp WHERE actual AND anomaly_type <> 'NORMAL' GROUP BY 1""")
def detection_by_type(q: Inputs):
    return evaluate.detection_by_type(_labelled(q))


@query("e3_detection_by_severity", """
SELECT severity, count(*) AS total, count(CASE WHEN predicted THEN 1 END) AS predicted FROM lp GROUP BY 1""")
def detection_by_severity(q: Inputs):
    return evaluate.detection_by_severity(_labelled(q))


@query("e4_target_checks", f"""{CONFUSION}
SELECT 'precision' AS metric, round_even(p1, 4) AS value, 0.75::DOUBLE AS target, round_even(p1, 4) > 0.75 AS reached FROM mm
UNION ALL SELECT 'recall', round_even(r1, 4), 0.70::DOUBLE, round_even(r1, 4) > 0.70 FROM mm
UNION ALL SELECT 'f1_score', round_even(f1, 4), 0.72::DOUBLE, round_even(f1, 4) > 0.72 FROM mm""")
def target_checks(q: Inputs):
    return evaluate.target_checks(evaluate.metrics(_labelled(q)))


@query("e5_anomaly_counts", f"""{CONFUSION}
SELECT tp + fn AS true_anomalies, round_even((tp + fn)::DOUBLE / total, 4) AS true_share, tp + fp AS predicted_anomalies,
  round_even((tp + fp)::DOUBLE / total, 4) AS predicted_share FROM mm""")
def anomaly_counts(q: Inputs):
    return evaluate.anomaly_counts(_labelled(q))


# --- rules -------------------------------------------------------------------------------

HITS = """
, hits AS (
  SELECT access_id, user_id, timestamp, department, 'off_hours_restricted' AS rule_id, 'HIGH' AS rule_severity, 'alert,block' AS actions
    FROM fx_logs WHERE hour(timestamp) NOT BETWEEN 8 AND 18 AND data_sensitivity = 'restricted'
  UNION ALL SELECT access_id, user_id, timestamp, department, 'bulk_rows', 'MEDIUM', 'alert' FROM fx_logs WHERE rowcount > 5000
  UNION ALL SELECT access_id, user_id, timestamp, department, 'external_export', 'CRITICAL', 'alert,block' FROM fx_logs
    WHERE query_type IN ('EXPORT', 'BULK_DOWNLOAD') AND destination IN ('external_email','usb_drive','cloud_storage','personal_device')
  UNION ALL SELECT access_id, user_id, timestamp, department, 'failed_from_outside', 'MEDIUM', 'alert' FROM fx_logs
    WHERE status <> 'success' AND NOT starts_with(source_ip, '10.')
)"""


def _hits(q: Inputs):
    return rules.rule_hits(q.logs, rules.DEFAULT_RULES)


@query("d1_rules", f"{HITS} SELECT access_id, rule_id, rule_severity, actions FROM hits")
def rule_engine(q: Inputs):
    return _hits(q).select(
        "access_id", "rule_id", "rule_severity", F.array_join("rule_actions", ",").alias("actions")
    )


@query("d2_approved_exceptions", f"""{HITS}
SELECT access_id, rule_id FROM hits WHERE NOT (rule_id = 'external_export' AND department = 'BUILDING' AND isodow(timestamp) = 5)
  AND NOT (rule_id = 'bulk_rows' AND department = 'MACHINERY' AND isodow(timestamp) = 1)""")
def approved_exceptions(q: Inputs):
    approved = q.spark.createDataFrame(
        [("external_export", "BUILDING", 4), ("bulk_rows", "MACHINERY", 0)],
        "rule_id string, department string, weekday int",
    )
    return rules.without_exceptions(_hits(q), approved).select("access_id", "rule_id")


@query("d2_known_periods", f"""{HITS}
SELECT access_id, rule_id FROM hits WHERE NOT (user_id % 3 = 0 AND EXISTS (SELECT 1 FROM fx_profiles p WHERE p.user_id = hits.user_id)
  AND timestamp BETWEEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (user_id % 20) AND TIMESTAMP '2024-01-06' + INTERVAL 1 DAY * (user_id % 20))""")
def known_periods(q: Inputs):
    shift = (col("user_id") % 20).cast("int")
    begin = lambda d: F.date_add(F.lit(d).cast("date"), shift).cast("timestamp")
    duty = q.profiles.where(col("user_id") % 3 == 0).select(
        "user_id", begin("2024-01-01").alias("starts"), begin("2024-01-06").alias("ends")
    )
    return rules.outside_context(_hits(q), duty).select("access_id", "rule_id")


@query("d7_outside_own_hours", """
SELECT access_id, CASE WHEN typical_access_hours IS NULL THEN 0 WHEN hour(timestamp) BETWEEN
  CAST(split_part(typical_access_hours, '-', 1) AS INTEGER) AND least(CAST(split_part(typical_access_hours, '-', 2) AS INTEGER), 23)
  THEN 0 ELSE 1 END AS outside FROM mg""")
def outside_own_hours(q: Inputs):
    return q.merged.select("access_id", rules.outside_typical_hours().alias("outside"))


@query("d10_typed_anomalies", """
SELECT access_id, anomaly_type, severity, is_anomaly, concat_ws(',', CASE WHEN t0 THEN 'NIGHT_BULK_CRITICAL' END,
  CASE WHEN t1 THEN 'EXFILTRATION_RISK' END, CASE WHEN t2 THEN 'PRE_RESIGNATION_DOWNLOAD' END, CASE WHEN t3 THEN 'BULK_EXPORT' END,
  CASE WHEN t4 THEN 'AFTER_HOURS_RESTRICTED' END, CASE WHEN t5 THEN 'STALE_ACCOUNT_ACCESS' END,
  CASE WHEN t6 THEN 'PRIVILEGE_ESCALATION' END, CASE WHEN t7 THEN 'CROSS_DEPT_ACCESS' END, CASE WHEN t8 THEN 'DEVICE_ANOMALY' END,
  CASE WHEN t9 THEN 'FAILED_AUTH_BURST' END) AS matched FROM fx_labels""")
def typed(q: Inputs):
    return q.typed.select(
        "access_id", "anomaly_type", "severity", "is_anomaly", F.array_join("matched_types", ",").alias("matched")
    )


@query("d11_naive_night", METRICS_SQL)
def naive(q: Inputs):
    return evaluate.metrics(evaluate.labelled(rules.naive_night(q.logs), q.labels))


# --- baselines ---------------------------------------------------------------------------


@query("d3_daily_rate", """
, d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM fx_logs GROUP BY 1, 2),
w AS (SELECT *, avg(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS u FROM d)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, round_even(u, 4) AS usual, round_even(n / u, 4) AS rate FROM w""")
def daily_rate(q: Inputs):
    return baselines.daily_rate(q.logs).withColumn("day", day_text())


def _z(m):
    return f"CASE WHEN {m}_std > 0 THEN ({m} - {m}_mean) / {m}_std ELSE 0 END"


@query("d4_deviations", f"""
, s AS (SELECT user_id, avg(rowcount) AS rowcount_mean, stddev_pop(rowcount) AS rowcount_std,
    avg(session_duration_min) AS session_duration_min_mean, stddev_pop(session_duration_min) AS session_duration_min_std,
    quantile_cont(CAST(rowcount AS DOUBLE), 0.25) AS rowcount_q1, quantile_cont(CAST(rowcount AS DOUBLE), 0.75) AS rowcount_q3,
    quantile_cont(CAST(session_duration_min AS DOUBLE), 0.25) AS session_duration_min_q1,
    quantile_cont(CAST(session_duration_min AS DOUBLE), 0.75) AS session_duration_min_q3 FROM fx_logs GROUP BY 1)
SELECT access_id, l.user_id, round_even({_z('rowcount')}, 4) AS z_rowcount, round_even({_z('session_duration_min')}, 4) AS z_session_duration_min,
  CASE WHEN rowcount < rowcount_q1 - (rowcount_q3 - rowcount_q1) * 1.5 OR rowcount > rowcount_q3 + (rowcount_q3 - rowcount_q1) * 1.5
    THEN 1 ELSE 0 END AS outlier_rowcount,
  CASE WHEN session_duration_min < session_duration_min_q1 - (session_duration_min_q3 - session_duration_min_q1) * 1.5
    OR session_duration_min > session_duration_min_q3 + (session_duration_min_q3 - session_duration_min_q1) * 1.5
    THEN 1 ELSE 0 END AS outlier_session_duration_min,
  round_even((abs({_z('rowcount')}) + abs({_z('session_duration_min')})) / 2, 4) AS deviation
FROM fx_logs l JOIN s ON l.user_id = s.user_id""")
def deviations(q: Inputs):
    return baselines.user_deviations(q.logs, ["rowcount", "session_duration_min"])


@query("d5_first_days_baseline", """
, b AS (SELECT *, CAST(timestamp AS DATE) < min(CAST(timestamp AS DATE)) OVER (PARTITION BY user_id) + 7 AS early,
    min(CAST(timestamp AS DATE)) OVER (PARTITION BY user_id) AS start FROM fx_logs)
SELECT user_id, strftime(min(start), '%Y-%m-%d') AS baseline_from, count(CASE WHEN early THEN 1 END) AS baseline_events,
  count(CASE WHEN NOT early THEN 1 END) AS later_events, round_even(avg(CASE WHEN early THEN rowcount END), 4) AS baseline_mean,
  round_even(avg(CASE WHEN NOT early THEN rowcount END), 4) AS later_mean,
  round_even(CASE WHEN avg(CASE WHEN early THEN rowcount END) <> 0
    THEN avg(CASE WHEN NOT early THEN rowcount END) / avg(CASE WHEN early THEN rowcount END) END, 4) AS change
FROM b GROUP BY 1""")
def first_days(q: Inputs):
    out = baselines.first_month_baseline(q.logs, "rowcount", days=7)
    return out.withColumn("baseline_from", day_text("baseline_from"))


@query("d6_asset_returns", """
, p AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY user_id, data_asset ORDER BY timestamp, access_id))
    / 86400000000 AS idle FROM fx_logs)
SELECT access_id, user_id, data_asset, idle IS NULL AS first_time, round_even(idle, 4) AS idle_days FROM p WHERE idle IS NULL OR idle >= 5""")
def asset_returns(q: Inputs):
    return baselines.asset_returns(q.logs, idle_days=5).drop("day")


@query("d8_seasonal_rate", """
, d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM fx_logs GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN last_day(day) - day < 3 AND month(day) % 3 = 0 THEN 'quarter_end' WHEN last_day(day) - day < 3 THEN 'month_end'
    ELSE 'ordinary' END AS phase FROM d),
w AS (SELECT *, avg(n) OVER (PARTITION BY user_id, phase) AS u FROM s)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, phase, n, round_even(u, 4) AS expected, round_even(n / u, 4) AS rate FROM w""")
def seasonal_rate(q: Inputs):
    return baselines.seasonal_rate(q.logs).withColumn("day", day_text())


@query("d8_seasonal_left_out", """
, d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, count(*) AS n FROM fx_logs GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN last_day(day) - day < 3 AND month(day) % 3 = 0 THEN 'quarter_end' WHEN last_day(day) - day < 3 THEN 'month_end'
    ELSE 'ordinary' END AS phase FROM d),
x AS (SELECT a.user_id, a.day, a.phase, a.n, avg(b.n) FILTER (isodow(b.day) = isodow(a.day)) AS u1, avg(b.n) AS u2
    FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND a.phase = b.phase AND a.day <> b.day GROUP BY 1, 2, 3, 4),
w AS (SELECT *, coalesce(u1, u2) AS u FROM x)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, phase, n, round_even(u, 4) AS expected, round_even(n / u, 4) AS rate FROM w""")
def seasonal_left_out(q: Inputs):
    return baselines.seasonal_rate_left_out(q.logs).withColumn("day", day_text())


@query("d9_rolling_board", """
, l AS (SELECT user_id, timestamp, severity FROM fx_labels WHERE is_anomaly),
g AS (SELECT unnest(generate_series(date_trunc('hour', min(timestamp)) + INTERVAL 1 HOUR, date_trunc('hour', max(timestamp)) + INTERVAL 72 HOUR,
    INTERVAL 1 HOUR)) AS as_of FROM l),
b AS (SELECT as_of, user_id, count(*) AS alerts, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical
    FROM g JOIN l ON timestamp < as_of AND timestamp >= as_of - INTERVAL 72 HOUR GROUP BY 1, 2)
SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, user_id, alerts, critical, place FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY alerts DESC, critical DESC, user_id) AS place FROM b) WHERE place <= 10""")
def rolling_board(q: Inputs):
    return baselines.riskiest_users_hourly(q.typed).withColumns(
        {"as_of": F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "place": col("place").cast("long")}
    )


@query("d9_riskiest_users", """
, d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, count(*) AS n, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS c
    FROM fx_labels WHERE is_anomaly GROUP BY 1, 2),
b AS (SELECT user_id, day + CAST(o AS INTEGER) AS day, CAST(sum(n) AS BIGINT) AS alerts, CAST(sum(c) AS BIGINT) AS critical
    FROM d, (SELECT unnest(range(3)) AS o) GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, user_id, alerts, critical, place FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY alerts DESC, critical DESC, user_id) AS place FROM b) WHERE place <= 10""")
def riskiest_users(q: Inputs):
    return baselines.riskiest_users(q.typed).withColumns(
        {"day": day_text(), "place": col("place").cast("long")}
    )


@query("d9_daily_report", """
SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS alerts, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical,
  count(CASE WHEN severity = 'HIGH' THEN 1 END) AS high, count(CASE WHEN severity = 'MEDIUM' THEN 1 END) AS medium,
  count(DISTINCT user_id) AS users FROM fx_labels WHERE is_anomaly GROUP BY 1""")
def daily_report(q: Inputs):
    return baselines.daily_report(q.typed).withColumn("day", day_text())


@query("d9_alert_ids", """
, s AS (SELECT access_id, timestamp, row_number() OVER (PARTITION BY CAST(timestamp AS DATE) ORDER BY timestamp, access_id) AS i
    FROM fx_labels WHERE is_anomaly)
SELECT access_id, 'ALERT-' || strftime(timestamp, '%Y%m%d') || '-' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0')
  ELSE CAST(i AS VARCHAR) END AS alert_id FROM s""")
def alert_ids(q: Inputs):
    alerts = q.typed.where("is_anomaly").select("access_id", "timestamp")
    placed = windows.sequence_by_time(alerts, "timestamp", ["access_id"], restart="day")
    day = F.date_format("timestamp", "yyyyMMdd")
    return placed.select(
        "access_id", F.concat(F.lit("ALERT-"), day, F.format_string("-%03d", col("seq") + 1)).alias("alert_id")
    )


@query("d12_weekly_false_positives", """
SELECT strftime(time_bucket(INTERVAL 7 DAY, decided_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week_from, department, anomaly_type,
  count(*) AS dismissed, count(DISTINCT user_id) AS users
FROM decisions WHERE decision = 'False Positive' GROUP BY 1, 2, 3""")
def weekly_false_positives(q: Inputs):
    out = feedback.weekly_false_positives(q.decisions, ["department", "anomaly_type"])
    return out.withColumn("week_from", day_text("week_from"))


@query("d12_training_feedback", """
SELECT access_id, Rowcount_Deviation FROM fe WHERE access_id NOT IN (SELECT access_id FROM decisions WHERE decision = 'Quarantine')""")
def training_feedback(q: Inputs):
    return feedback.training_feedback(q.enriched, q.decisions).select("access_id", "Rowcount_Deviation")


@query("d13_peer_deviation", """
, u AS (SELECT department, user_id, avg(rowcount) AS own FROM fx_logs GROUP BY 1, 2),
p AS (SELECT department, avg(own) AS m, stddev_pop(own) AS s, count(*) AS peers FROM u GROUP BY 1)
SELECT u.department, user_id, peers, round_even(own, 4) AS own_mean, round_even(CASE WHEN s > 0 THEN (own - m) / s ELSE 0 END, 4) AS z
FROM u JOIN p ON u.department = p.department""")
def peer_deviation(q: Inputs):
    return baselines.peer_deviation(q.logs, "rowcount")


@query("d13_user_groups")
def user_groups(q: Inputs):
    return baselines.user_groups(q.logs).select("user_id", "group")


@query("d14_risk_trend", """
, d AS (SELECT user_id, CAST(timestamp AS DATE) AS day, avg(CASE WHEN is_anomaly THEN 1.0::DOUBLE ELSE 0 END) AS risk FROM fx_labels GROUP BY 1, 2)
SELECT user_id, count(*) AS days, round_even(CASE WHEN count(*) > 1 THEN regr_slope(risk, CAST(day - DATE '1970-01-01' AS DOUBLE)) END, 6) AS slope
FROM d GROUP BY 1""")
def risk_trend(q: Inputs):
    return baselines.risk_trend(q.typed)


@query("d15_failure_bursts", """
, f AS (SELECT access_id, user_id, timestamp FROM fx_logs WHERE status <> 'success'),
c AS (SELECT access_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(timestamp)
    RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, timestamp)
    + row_number() OVER (PARTITION BY user_id, timestamp ORDER BY access_id) AS BIGINT) AS failures FROM f)
SELECT access_id, user_id, failures FROM c WHERE failures >= 2""")
def failure_bursts(q: Inputs):
    return baselines.failure_bursts(q.logs, seconds=12 * 3600).select("access_id", "user_id", "failures")


@query("d15_pauses", """
SELECT access_id, user_id, round_even((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY user_id ORDER BY timestamp, access_id))
  / 1000000, 3) AS seconds_since_previous FROM fx_logs""")
def pauses(q: Inputs):
    return baselines.pauses(q.logs)


@query("d16_action_sequences", """
, g AS (SELECT user_id, lag(query_type, 2) OVER w AS a, lag(query_type, 1) OVER w AS b, query_type AS c FROM fx_logs
    WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, access_id)),
s AS (SELECT user_id, a || '>' || b || '>' || c AS sequence, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY 1, 2)
SELECT user_id, sequence, n, CAST(sum(n) OVER (PARTITION BY sequence) AS BIGINT) AS total, count(*) OVER (PARTITION BY sequence) AS users FROM s""")
def action_sequences(q: Inputs):
    return baselines.action_sequences(q.logs)


@query("d16_action_shifts", """
, g AS (SELECT user_id, timestamp, lag(query_type) OVER (PARTITION BY user_id ORDER BY timestamp, access_id) AS a, query_type AS b FROM fx_logs),
s AS (SELECT user_id, concat_ws('>', a, b) AS step, timestamp > (SELECT max(timestamp) FROM g WHERE a IS NOT NULL) - INTERVAL 7 DAY AS now
    FROM g WHERE a IS NOT NULL),
c AS (SELECT user_id, step, count(*) FILTER (now) AS n, count(*) FILTER (NOT now) AS m FROM s GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS tn, sum(m) OVER (PARTITION BY user_id) AS tm FROM c)
SELECT user_id, CAST(max(tn) AS BIGINT) AS recent_steps, CAST(max(tm) AS BIGINT) AS earlier_steps,
  round_even(sum(abs(n::DOUBLE / tn - m::DOUBLE / tm)) / 2, 4) AS shift FROM p WHERE tn > 0 AND tm > 0 GROUP BY 1""")
def action_shifts(q: Inputs):
    return baselines.action_shifts(q.logs)


@query("d17_watch_list", """
, m AS (SELECT DISTINCT user_id, decided_at FROM decisions WHERE decision = 'Monitor')
SELECT l.access_id, l.user_id, strftime(max(decided_at), '%Y-%m-%d %H:%M:%S') AS watched_since FROM fx_logs l
JOIN m ON l.user_id = m.user_id AND l.timestamp BETWEEN decided_at AND decided_at + INTERVAL 48 HOUR GROUP BY 1, 2""")
def watch_list(q: Inputs):
    slim = q.logs.select("access_id", "user_id", "timestamp")
    return feedback.watch_list(slim, q.decisions).select(
        "access_id", "user_id", F.date_format("watched_since", "yyyy-MM-dd HH:mm:ss").alias("watched_since")
    )


@query("r5_sessions", """
, g AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR timestamp - lag(timestamp) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o
    FROM fx_logs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, access_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY timestamp, access_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_event,
  count(*) AS events FROM s GROUP BY user_id, sid""")
def sessions(q: Inputs):
    found = windows.sessions(q.logs, "user_id", "timestamp", gap_minutes=360)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", shown("session_start"), shown("last_event"), "events")
