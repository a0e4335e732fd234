"""Scans, sinks, projections, joins, features, windows, sorts, sets, scalar and nested functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wardline.functions.numeric import round_to
from wardline import dims, schemas
from wardline.catalog.registry import FEATURE_LIST, Inputs, query, time_text
from wardline.functions import features as fx, responses, scoring, text
from wardline.operators import attribution, filters, joins, rules, triage, windows
from wardline.plans import enrich as plan
from wardline.session import fresh_path
from wardline.sources import checked, readers, sample_views as views, writers
from wardline.streaming import ingest

col = F.col

# --- sources and sinks -------------------------------------------------------------------

RAW_LOGS = """
SELECT CAST(access_id AS VARCHAR) AS access_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CAST(user_id AS VARCHAR) AS user_id, username, department, data_asset, data_sensitivity, data_category, query_type,
  rowcount, access_method, destination, status, source_ip, bytes_transferred, session_duration_min,
  client_application, authentication_method, is_vpn, geo_location, time_classification, anomaly_marker
FROM fx_logs"""


@query("s1_scan_logs", RAW_LOGS)
def scan_logs(q: Inputs):
    path = fresh_path(q.spark, "logs_csv")
    writers.write_raw(q.logs, schemas.LOGS, path)
    logs = readers.read_logs(q.spark, path, "csv")
    return logs.withColumn("timestamp", time_text("timestamp"))


# what stands in a cell instead, by the last digit of the event's id
SPOILED = {"timestamp": "soon", "rowcount": "many", "is_vpn": "maybe", "session_duration_min": "1,5", "bytes_transferred": "2.5"}


@query("s1_rejected_cells", "SELECT 'sound' AS part, '' AS cell, count(*) AS n FROM fx_logs"
       " WHERE right(CAST(access_id AS VARCHAR), 1) NOT IN ('0', '1', '2', '3', '4')"
       + "".join(f" UNION ALL SELECT 'rejected', '{c}', count(*) FROM fx_logs"
                 f" WHERE right(CAST(access_id AS VARCHAR), 1) = '{d}' HAVING count(*) > 0" for d, c in enumerate(SPOILED)))
def rejected_cells(q: Inputs):
    """The logs as CSV with half of the rows spoiled in one cell, read back with every cell checked."""
    plain = q.logs.withColumn("timestamp", time_text("timestamp"))
    plain = plain.select(*[col(f.name).cast("string").alias(f.name) for f in schemas.LOGS])
    spoiled = {
        c: F.when(F.right("access_id", F.lit(1)) == str(d), F.lit(v)).otherwise(col(c))
        for d, (c, v) in enumerate(SPOILED.items())
    }
    path = fresh_path(q.spark, "logs_spoiled")
    plain.withColumns(spoiled).write.options(header=True).csv(path)
    done = checked.split_checked(checked.read_checked(q.spark, path, schemas.LOGS), fresh_path(q.spark, "logs_checked"))
    entries = done.rejected.select(F.explode("rejected").alias("e")).select("e.cell")
    counted = entries.groupBy(F.lit("rejected").alias("part"), "cell").agg(F.count("*").alias("n"))
    return done.sound.agg(F.lit("sound").alias("part"), F.lit("").alias("cell"), F.count("*").alias("n")).union(counted)


@query("s2_scan_profiles", """
SELECT CAST(user_id AS VARCHAR) AS user_id, username, email, department, job_title, access_tier, tenure_months,
  approved_data_assets, avg_queries_per_day, typical_access_hours, avg_rowcount_per_query, high_risk_flag, equipment,
  clearance_level, notice_period, last_performance_rating, security_training_current, failed_logins_30d, vpn_user,
  strftime(last_access_date, '%Y-%m-%d') AS last_access_date
FROM fx_profiles""")
def scan_profiles(q: Inputs):
    path = fresh_path(q.spark, "profiles_csv")
    writers.write_raw(q.profiles, schemas.PROFILES, path)
    profiles = readers.read_profiles(q.spark, path, "csv")
    return profiles.withColumn("last_access_date", F.date_format("last_access_date", "yyyy-MM-dd"))


@query("s3_scan_labels", """
SELECT CAST(access_id AS VARCHAR) AS access_id, is_anomaly, anomaly_type, severity,
  CASE WHEN is_anomaly THEN 'Matches the rule ' || anomaly_type || '.' ELSE 'No rule matched.' END AS explanation
FROM fx_labels""")
def scan_labels(q: Inputs):
    path = fresh_path(q.spark, "labels_csv")
    writers.write_raw(q.labels, schemas.EVENT_LABELS, path)
    return readers.read_event_labels(q.spark, path, "csv")


@query("s4_feature_matrix", f"SELECT access_id, {FEATURE_LIST} FROM fe")
def matrix(q: Inputs):
    as_text = F.when(col("high_risk_flag") == 1, "True").otherwise("False")
    loose = q.stored.withColumns(
        {"high_risk_flag": as_text, "Weak_Auth_Flag": col("Weak_Auth_Flag") == 1}
    )
    return readers.feature_matrix(loose).drop("user_id", "timestamp")


@query("s6_write_enriched", """
SELECT strftime(timestamp, '%Y-%m-%d') AS event_date, count(*) AS n,
  round_even(sum(Stale_Sensitivity_Risk), 2) AS stale, CAST(sum(Temporal_Velocity) AS BIGINT) AS velocity
FROM fe GROUP BY 1""")
def enriched_round_trip(q: Inputs):
    path = fresh_path(q.spark, "enriched_by_day")
    writers.write_enriched(q.enriched, path)
    stored = q.spark.read.parquet(path)
    return stored.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_date")).agg(
        F.count("*").alias("n"),
        round_to(F.sum("Stale_Sensitivity_Risk"), 2).alias("stale"),
        F.sum("Temporal_Velocity").cast("long").alias("velocity"),
    )


@query("s7_write_raw", """
SELECT 'event_labels' AS table_name, count(*) AS n, count(DISTINCT anomaly_type) AS kinds FROM fx_labels
UNION ALL SELECT 'logs', count(*), count(DISTINCT data_asset) FROM fx_logs
UNION ALL SELECT 'profiles', count(*), count(DISTINCT access_tier) FROM fx_profiles
UNION ALL SELECT 'user_labels', count(*), 2 FROM fx_profiles""")
def raw_round_trip(q: Inputs):
    def stored(df, schema, name, kind):
        path = fresh_path(q.spark, name)
        writers.write_raw(df, schema, path, "parquet")
        return readers.read_table(q.spark, path, schema).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n"), F.countDistinct(kind).alias("kinds")
        )

    return (
        stored(q.logs, schemas.LOGS, "logs", "data_asset")
        .unionByName(stored(q.profiles, schemas.PROFILES, "profiles", "access_tier"))
        .unionByName(stored(q.labels, schemas.EVENT_LABELS, "event_labels", "anomaly_type"))
        .unionByName(stored(views.user_labels(q.profiles), schemas.USER_LABELS, "user_labels", "risk_type"))
    )


# --- projections and filters -------------------------------------------------------------


@query("p1_projection", f"""
SELECT access_id, user_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, {FEATURE_LIST} FROM fe""")
def projection(q: Inputs):
    return q.enriched.withColumn("timestamp", time_text("timestamp"))


@query("p2_drop_clashes", """
SELECT user_id, job_title, access_tier, tenure_months, approved_data_assets, avg_queries_per_day, typical_access_hours,
  avg_rowcount_per_query, high_risk_flag, equipment, clearance_level, notice_period, last_performance_rating,
  security_training_current, failed_logins_30d, vpn_user, strftime(last_access_date, '%Y-%m-%d') AS last_access_date
FROM fx_profiles""")
def drop_clashes(q: Inputs):
    kept = joins.without_clashes(q.profiles)
    return kept.withColumn("last_access_date", F.date_format("last_access_date", "yyyy-MM-dd"))


@query("p3_null_fill", f"SELECT access_id, {FEATURE_LIST} FROM fe WHERE user_id % 20 = 7")
def null_fill(q: Inputs):
    orphans = joins.orphan_events(q.logs, q.profiles)
    return plan.enrich(orphans, q.profiles, views.REFERENCE_DATE).drop("user_id", "timestamp")


@query("p4_predicted_anomalies", "SELECT access_id, anomaly_score FROM rp WHERE prediction = -1")
def predicted(q: Inputs):
    return filters.predicted_anomalies(q.rule_scored).select("access_id", "anomaly_score")


@query("p5_severity_filter", """
SELECT 'ALL' AS wanted, access_id, severity FROM fx_labels
UNION ALL SELECT severity, access_id, severity FROM fx_labels WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')""")
def severity_filter(q: Inputs):
    def kept(wanted):
        return filters.by_severity(q.labels, wanted).select(
            F.lit(wanted).alias("wanted"), "access_id", "severity"
        )

    return reduce(DataFrame.unionByName, map(kept, ["ALL", "CRITICAL", "HIGH", "MEDIUM"]))


@query("p6_cohorts", """
SELECT user_id, high_risk_flag AS high_risk, last_access_date < DATE '2024-01-31' - 50 AS stale,
  notice_period AS on_notice, coalesce(access_tier, '') IN ('junior', 'standard') AS junior,
  coalesce(access_tier, '') = 'contractor' AS contractor
FROM fx_profiles""")
def cohorts(q: Inputs):
    return q.profiles.select(
        "user_id", *[c.alias(n) for n, c in filters.cohorts(views.REFERENCE_DATE).items()]
    )


@query("p7_marked_and_night", """
SELECT 'marked' AS kind, access_id FROM fx_logs WHERE anomaly_marker IS NOT NULL
UNION ALL SELECT 'night', access_id FROM fx_logs WHERE hour(timestamp) >= 22 OR hour(timestamp) <= 6""")
def marked_and_night(q: Inputs):
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "access_id")
    return tag(filters.marked_events(q.logs), "marked").unionByName(
        tag(filters.night_events(q.logs), "night")
    )


@query("p8_exposure", """
SELECT access_id, NOT starts_with(source_ip, '10.') AS external_ip,
  destination IN ('external_email','usb_drive','cloud_storage','personal_device') AS external_destination,
  geo_location IN ('Unknown_VPN','Tor_Exit_Node','Lagos','Pyongyang','Caracas') AS suspicious_geo
FROM fx_logs""")
def exposure(q: Inputs):
    return filters.exposure_flags(q.logs).select(
        "access_id", "external_ip", "external_destination", "suspicious_geo"
    )


@query("p9_senior_titles", f"""
SELECT user_id, job_title FROM fx_profiles WHERE regexp_matches(job_title, '{"|".join(dims.SENIOR_WORDS)}')""")
def senior_titles(q: Inputs):
    return q.profiles.where(filters.is_senior_title()).select("user_id", "job_title")


# --- joins -------------------------------------------------------------------------------


@query("j1_merge", """
SELECT access_id, user_id, department, data_asset, job_title, access_tier, tenure_months, approved_data_assets,
  avg_rowcount_per_query, equipment, vpn_user, failed_logins_30d, CAST(high_risk_flag AS INTEGER) AS high_risk_flag,
  CAST(notice_period AS INTEGER) AS notice_period_flag, CAST(stale_account_days AS INTEGER) AS stale_account_days,
  Tenure_Risk_Modifier
FROM mg""")
def merge(q: Inputs):
    return q.merged.select(
        "access_id", "user_id", "department", "data_asset", "job_title", "access_tier", "tenure_months",
        "approved_data_assets", "avg_rowcount_per_query", "equipment", "vpn_user", "failed_logins_30d",
        "high_risk_flag", "notice_period_flag", "stale_account_days", "Tenure_Risk_Modifier",
    )


@query("j2_orphans", "SELECT user_id, count(*) AS n FROM fx_logs WHERE user_id % 20 = 7 GROUP BY 1")
def orphans(q: Inputs):
    return joins.orphan_events(q.logs, q.profiles).groupBy("user_id").agg(F.count("*").alias("n"))


@query("j3_first_per_key", """
SELECT user_id, access_id, data_asset, status FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, access_id) AS rn FROM fx_logs)
WHERE rn = 1""")
def first_per_key(q: Inputs):
    slim = q.logs.select("user_id", "timestamp", "access_id", "data_asset", "status")
    return joins.first_per_key(slim, ["user_id"], ["timestamp", "access_id"]).drop("timestamp")


@query("j4_labels_with_defaults", """
SELECT r.access_id, anomaly_score, coalesce(is_anomaly, false) AS is_anomaly, coalesce(anomaly_type, 'UNKNOWN') AS anomaly_type,
  coalesce(severity, 'NONE') AS severity,
  CASE WHEN is_anomaly THEN 'Matches the rule ' || anomaly_type || '.' ELSE '' END AS explanation
FROM rp r LEFT JOIN (SELECT * FROM fx_labels WHERE is_anomaly) l ON r.access_id = l.access_id WHERE prediction = -1""")
def label_defaults(q: Inputs):
    alerts = filters.predicted_anomalies(q.rule_scored).select("access_id", "anomaly_score")
    return joins.with_labels(alerts, q.labels.where("is_anomaly"))


@query("j5_context_with_defaults", """
SELECT r.access_id, coalesce(username, 'unknown') AS username, coalesce(department, 'unknown') AS department,
  coalesce(data_asset, 'unknown') AS data_asset, coalesce(data_sensitivity, 'unknown') AS data_sensitivity,
  coalesce(query_type, 'unknown') AS query_type, coalesce(destination, 'unknown') AS destination
FROM rp r LEFT JOIN (SELECT * FROM fx_logs WHERE status = 'success') l ON r.access_id = l.access_id WHERE prediction = -1""")
def context_defaults(q: Inputs):
    alerts = filters.predicted_anomalies(q.rule_scored).select("access_id")
    return joins.with_context(alerts, q.logs.where(col("status") == "success"))


@query("j6_dimension_lookups", """
SELECT access_id, sens AS sensitivity,
  CASE access_tier WHEN 'junior' THEN 1 WHEN 'contractor' THEN 1 WHEN 'senior' THEN 3 WHEN 'admin' THEN 4 ELSE 2 END AS tier,
  Exfiltration_Dest_Score AS destination, Query_Type_Risk AS query,
  CASE time_classification WHEN 'night' THEN 3 WHEN 'weekend' THEN 2 WHEN 'after_hours' THEN 2 WHEN 'early_morning' THEN 1 ELSE 0 END AS time_weight
FROM f1""")
def dimension_lookups(q: Inputs):
    look = dims.score_of
    return q.merged.select(
        "access_id",
        fx.sensitivity_score().alias("sensitivity"),
        look(text.clean(col("access_tier"), "standard"), dims.TIER_SCORE, dims.TIER_DEFAULT).alias("tier"),
        look(text.clean(col("destination")), dims.DESTINATION_RISK, 0).alias("destination"),
        look(text.clean(col("query_type")), dims.QUERY_RISK, 0).alias("query"),
        look(text.clean(col("time_classification")), dims.TIME_WEIGHT, 0).alias("time_weight"),
    )


@query("j7_asset_dimension", """
SELECT access_id, data_asset, ['low', 'medium', 'high', 'restricted'][p_size % 4 + 1] AS sensitivity, p_type AS category
FROM fx_logs LEFT JOIN part ON data_asset = 'ASSET_' || p_partkey""")
def asset_dimension(q: Inputs):
    return joins.with_asset_dimension(q.logs.select("access_id", "data_asset"), views.assets(q.spark, q.sf_dir))


@query("j8_feature_text", """
SELECT access_id, place, t.feature, display_name, description FROM top3 t JOIN fd ON t.feature = fd.feature""")
def feature_text(q: Inputs):
    top = q.rule_explained.select("access_id", F.posexplode(attribution.top_features(col("attribution"))))
    named = top.select("access_id", (col("pos") + 1).cast("long").alias("place"), "col.feature")
    return joins.with_feature_text(named)


@query("j9_aligned_predictions", "SELECT access_id, predicted, actual, anomaly_type, severity FROM lp")
def aligned(q: Inputs):
    from wardline.operators.evaluate import labelled

    return labelled(rules.naive_night(q.logs), q.labels)


# --- features ----------------------------------------------------------------------------


def _register_feature(number: int, name: str) -> None:
    @query(f"f{number}_{name.lower()}", f"SELECT access_id, {name} FROM fe")
    def one_feature(q: Inputs):
        if name == plan.VELOCITY:
            return q.enriched.select("access_id", name)
        value = F.coalesce(col(name).cast("double"), F.lit(0.0))
        return q.featured.select("access_id", value.alias(name))


for _i, _name in enumerate(schemas.FEATURES, 1):
    _register_feature(_i, _name)


# --- windows, sorts, sets ----------------------------------------------------------------


@query("w1_trailing_hours_sorted", """
SELECT access_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(timestamp)
  RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY user_id, timestamp)
  + row_number() OVER (PARTITION BY user_id, timestamp ORDER BY access_id) AS BIGINT) AS n
FROM fx_logs""")
def trailing_sorted(q: Inputs):
    """Six hours, by the path for dense cells, so that it is checked on whole data too."""
    keys = q.logs.select("user_id", "timestamp")
    slim = q.logs.select("access_id", "user_id", "timestamp")
    counted = windows.trailing_count(
        slim, keys, "user_id", "timestamp", "access_id", "n", 6 * 3600, dense_cell_rows=0
    )
    return counted.select("access_id", "n")


@query("w2_resequence", """
SELECT access_id, 'ACC-' || lpad(CAST(seq AS VARCHAR), CAST(greatest(6, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS new_id FROM (
  SELECT access_id, row_number() OVER (ORDER BY timestamp, access_id) - 1 AS seq FROM fx_logs)""")
def resequence(q: Inputs):
    slim = q.logs.select("access_id", "timestamp")
    placed = windows.sequence_by_time(slim, "timestamp", ["access_id"])
    return placed.select("access_id", F.format_string("ACC-%06d", "seq").alias("new_id"))


RANKED = """
SELECT access_id, anomaly_score FROM rp WHERE prediction = -1 ORDER BY anomaly_score, access_id LIMIT {}"""


@query("w3_rank_anomalies", """
SELECT access_id, anomaly_score, rank FROM (
  SELECT *, row_number() OVER (ORDER BY anomaly_score, access_id) AS rank FROM rp WHERE prediction = -1)
WHERE rank <= 200""")
def rank_anomalies(q: Inputs):
    from pyspark.sql import Window

    top = triage.most_anomalous(q.rule_scored, 200)
    # 200 rows by then, so one task ranks them
    order = Window.orderBy("anomaly_score", "access_id")
    return top.select("access_id", "anomaly_score", F.row_number().over(order).cast("long").alias("rank"))


@query("k1_top_alerts", RANKED.format(50))
def top_alerts(q: Inputs):
    return triage.most_anomalous(q.rule_scored, 50).select("access_id", "anomaly_score")


@query("k2_top_features", "SELECT access_id, place, feature, shap_value, event_value FROM top3")
def top_features(q: Inputs):
    top = q.rule_explained.select("access_id", F.posexplode(attribution.top_features(col("attribution"))))
    return top.select("access_id", (col("pos") + 1).cast("long").alias("place"), "col.*")


@query("k3_order_within_day", """
SELECT access_id, row_number() OVER (PARTITION BY date_trunc('day', timestamp) ORDER BY timestamp, access_id) - 1 AS position
FROM fx_logs""")
def order_within_day(q: Inputs):
    slim = q.logs.select("access_id", "timestamp")
    return windows.sequence_by_time(
        slim, "timestamp", ["access_id"], out="position", restart="day"
    ).select("access_id", "position")


@query("u1_append", """
SELECT access_id, 'anomalous' AS part FROM fx_labels WHERE is_anomaly
UNION ALL SELECT access_id, 'normal' FROM fx_labels WHERE NOT is_anomaly""")
def append(q: Inputs):
    part = lambda keep, name: q.labels.where(keep).select("access_id", F.lit(name).alias("part"))
    return part(col("is_anomaly"), "anomalous").unionByName(part(~col("is_anomaly"), "normal"))


# --- scalar functions --------------------------------------------------------------------


@query("c1_normalise", """
SELECT event_id, lower(event_type) AS kind, CASE WHEN event_id % 4 = 0 THEN 'low' ELSE 'high' END AS level FROM events""",
       prelude=False)
def normalise(q: Inputs):
    padded = F.concat(F.lit(" \t"), F.upper("event_type"), F.lit(" \n"))
    level = F.when(col("event_id") % 4 != 0, " HIGH ")
    return q.table("events").select(
        "event_id", text.clean(padded).alias("kind"), text.clean(level, "low").alias("level")
    )


@query("c2_time_class", "SELECT access_id, time_classification FROM fx_logs")
def time_class(q: Inputs):
    return q.logs.select("access_id", text.time_class(col("timestamp")).alias("time_classification"))


@query("c3_typical_hours", """
SELECT user_id, CAST(split_part(typical_access_hours, '-', 1) AS INTEGER) AS lo,
  CAST(split_part(typical_access_hours, '-', 2) AS INTEGER) AS hi FROM fx_profiles""")
def typical_hours(q: Inputs):
    lo, hi = text.hours_range(col("typical_access_hours"))
    return q.profiles.select("user_id", lo.alias("lo"), hi.alias("hi"))


SCORE = "CAST(round_even((0.5 - greatest(-0.5, least(0.5, anomaly_score))) * 100, 0) AS INTEGER)"
BAND = f"CASE WHEN {SCORE} >= 80 THEN 'critical' WHEN {SCORE} >= 60 THEN 'high' WHEN {SCORE} >= 40 THEN 'elevated' ELSE 'low' END"
ACTION = "CASE WHEN anomaly_score < -0.3 THEN 'Quarantine' WHEN anomaly_score < -0.1 THEN 'Investigate' ELSE 'Monitor' END"


@query("c4_risk_score", f"SELECT access_id, {SCORE} AS risk_score FROM rp")
def risk_score(q: Inputs):
    return q.rule_scored.select("access_id", scoring.risk_score(col("anomaly_score")).alias("risk_score"))


@query("c5_risk_band", f"SELECT access_id, {BAND} AS band FROM rp")
def risk_band(q: Inputs):
    score = scoring.risk_score(col("anomaly_score"))
    return q.rule_scored.select("access_id", scoring.risk_band(score).alias("band"))


@query("c6_action", f"SELECT access_id, {ACTION} AS action FROM rp")
def action(q: Inputs):
    return q.rule_scored.select(
        "access_id", scoring.recommended_action(col("anomaly_score")).alias("action")
    )


@query("c7_user_display", """
SELECT user_id, 'Customer ' || split_part(c_name, '#', 2) AS dotted, c_name AS plain, 'USR.' || c_custkey AS id_like
FROM fx_profiles JOIN customer ON user_id = c_custkey""")
def user_display(q: Inputs):
    dotted = F.lower(F.replace("username", F.lit("#"), F.lit(".")))
    id_like = F.concat(F.lit("USR."), col("user_id").cast("string"))
    return q.profiles.select(
        "user_id",
        scoring.display_user(dotted).alias("dotted"),
        scoring.display_user(col("username")).alias("plain"),
        scoring.display_user(id_like).alias("id_like"),
    )


@query("c8_display_names", """
SELECT access_id, replace(data_asset, '_', ' ') AS asset,
  CASE anomaly_marker WHEN 'FAILED_AUTH_BURST' THEN 'Failed Auth Burst' END AS kind,
  trim(regexp_replace(replace(authentication_method, '_', ' '), '([A-Z])', ' \\1', 'g')) AS feature
FROM fx_logs""")
def display_names(q: Inputs):
    return q.logs.select(
        "access_id",
        scoring.display_asset(col("data_asset")).alias("asset"),
        scoring.display_type(col("anomaly_marker")).alias("kind"),
        scoring.display_feature(col("authentication_method")).alias("feature"),
    )


@query("c9_time_display", """
SELECT access_id, strftime(timestamp, '%d %b %Y at %H:%M') AS shown, 'access ' || access_id AS unreadable FROM fx_logs""")
def time_display(q: Inputs):
    odd = F.concat(F.lit("access "), col("access_id").cast("string"))
    return q.logs.select(
        "access_id",
        scoring.display_time(time_text("timestamp")).alias("shown"),
        scoring.display_time(odd).alias("unreadable"),
    )


HASH = """sha256('data_asset=' || coalesce(data_asset, '\\N') || '|destination=' || coalesce(destination, '\\N')
  || '|query_type=' || coalesce(query_type, '\\N') || '|user_id=' || coalesce(CAST(user_id AS VARCHAR), '\\N'))"""
CONTENT = ["user_id", "query_type", "data_asset", "destination"]


@query("c10_content_hash", f"SELECT access_id, {HASH} AS event_hash FROM fx_logs")
def content_hash(q: Inputs):
    return q.logs.select("access_id", text.content_hash(CONTENT).alias("event_hash"))


@query("c11_bar_widths", """
SELECT access_id, i, round_even(CASE WHEN m > 0 THEN abs(shap_value) / m * 100 ELSE 0 END, 4) AS width FROM (
  SELECT *, max(abs(shap_value)) OVER (PARTITION BY access_id) AS m FROM pa)""")
def bar_widths(q: Inputs):
    widths = scoring.bar_widths(col("attribution.shap_value"))
    spread = q.rule_explained.select("access_id", F.posexplode(widths).alias("i", "w"))
    return spread.select("access_id", "i", round_to("w", 4).alias("width"))


@query("c12_truth_tag", "SELECT access_id, CASE WHEN actual THEN 'TP' ELSE 'FP' END AS tag FROM lp WHERE predicted")
def truth_tag(q: Inputs):
    from wardline.operators.evaluate import labelled

    hits = labelled(rules.naive_night(q.logs), q.labels).where("predicted")
    return hits.select("access_id", scoring.truth_tag(col("actual")).alias("tag"))


@query("c13_rounding", """
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount / 7, 6) AS six,
  round_even(l_extendedprice * l_discount / 7, 4) AS four FROM lineitem""", prelude=False)
def rounding(q: Inputs):
    value = col("l_extendedprice") * col("l_discount") / 7
    return q.table("lineitem").select(
        "l_orderkey", "l_linenumber", round_to(value, 6).alias("six"), round_to(value, 4).alias("four")
    )


# --- nested data and text ----------------------------------------------------------------


@query("n1_pipe_list", """
SELECT user_id, len(approved_assets) AS n, array_to_string(approved_assets, ',') AS items,
  list_contains(approved_assets, 'ASSET_' || (user_id % 7)) AS has_asset FROM pf""")
def pipe_list(q: Inputs):
    items = text.pipe_list(col("approved_data_assets"))
    wanted = F.concat(F.lit("ASSET_"), (col("user_id") % 7).cast("string"))
    return q.profiles.select(
        "user_id",
        F.size(items).cast("long").alias("n"),
        F.array_join(items, ",").alias("items"),
        text.in_list(items, wanted).alias("has_asset"),
    )


@query("n2_attribution_entries", "SELECT access_id, feature, shap_value, event_value FROM pa")
def attribution_entries(q: Inputs):
    return q.rule_explained.select("access_id", F.inline("attribution"))


SENSITIVE_REACH = """
reach AS (
  SELECT DISTINCT user_id FROM (SELECT user_id, unnest(approved_assets) AS data_asset FROM pf WHERE access_tier = 'contractor') u
  JOIN (SELECT DISTINCT data_asset FROM fx_logs WHERE data_sensitivity IN ('high', 'restricted')) s ON u.data_asset = s.data_asset
),
why AS (
  SELECT pf.user_id, high_risk_flag, failed_logins_30d, last_performance_rating, len(approved_assets) AS n_assets, list_filter([
    CASE WHEN notice_period THEN 'resignation_filed' END,
    CASE WHEN last_performance_rating <= 2 THEN 'low_performance_pip' END,
    CASE WHEN failed_logins_30d >= 10 THEN 'account_compromise_risk' END,
    CASE WHEN reach.user_id IS NOT NULL THEN 'contractor_sensitive_access' END], lambda r: r IS NOT NULL) AS reasons
  FROM pf LEFT JOIN reach ON pf.user_id = reach.user_id
)"""


@query("n3_risk_reasons", f", {SENSITIVE_REACH} SELECT user_id, array_to_string(reasons, ',') AS reasons FROM why")
def risk_reasons(q: Inputs):
    found = rules.risk_reasons(q.profiles, views.assets_of(q.logs))
    return found.select("user_id", F.array_join("reasons", ",").alias("reasons"))


@query("n4_user_labels", f""", {SENSITIVE_REACH}
SELECT user_id, len(reasons) > 0 OR high_risk_flag AS is_anomaly,
  CASE WHEN list_contains(reasons, 'resignation_filed') THEN 'NOTICE_PERIOD_RISK'
    WHEN list_contains(reasons, 'account_compromise_risk') THEN 'STALE_ACCOUNT'
    WHEN list_contains(reasons, 'contractor_sensitive_access') THEN 'OVER_PRIVILEGED'
    WHEN list_contains(reasons, 'low_performance_pip') THEN 'NOTICE_PERIOD_RISK'
    WHEN high_risk_flag THEN 'EXCESSIVE_SYSTEMS' ELSE 'NORMAL' END AS risk_type,
  CASE WHEN list_contains(reasons, 'resignation_filed') OR list_contains(reasons, 'account_compromise_risk') THEN 'HIGH'
    WHEN len(reasons) > 0 OR high_risk_flag THEN 'MEDIUM' ELSE 'NONE' END AS severity,
  CASE WHEN list_contains(reasons, 'resignation_filed') THEN 'On notice, may use ' || n_assets || ' assets.'
    WHEN list_contains(reasons, 'account_compromise_risk') THEN failed_logins_30d || ' failed logins in 30 days.'
    WHEN list_contains(reasons, 'contractor_sensitive_access') THEN 'Contractor approved for sensitive assets.'
    WHEN list_contains(reasons, 'low_performance_pip') THEN 'Rated ' || printf('%.1f', last_performance_rating) || '.'
    WHEN high_risk_flag THEN 'Marked as a risk without a listed reason.' ELSE 'Nothing out of the ordinary.' END AS explanation
FROM why""")
def user_labels(q: Inputs):
    return rules.user_risk_labels(rules.risk_reasons(q.profiles, views.assets_of(q.logs)))


def _responses(q: Inputs):
    """Response texts made from the scored events: plain, fenced, embedded and broken JSON."""
    said = views.pick(["Quarantine", "Escalate", "Monitor"], col("access_id") % 3)
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Event "), col("access_id").cast("string"), F.lit(" stands out.")).alias("threat_narrative"),
            F.array(F.lit("rows"), F.lit("hour")).alias("evidence_list"),
            said.alias("recommended_action"),
        )
    )
    shape = col("access_id") % 4
    answer = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here is my view: "), body, F.lit(" Ask if unclear.")))
        .otherwise(F.concat(F.lit("I cannot answer {"), said))
    )
    return q.rule_scored.select("access_id", "anomaly_score", answer.alias("answer"))


@query("n5_json_salvage", f"""
SELECT access_id, access_id % 4 < 3 AS is_json,
  CASE WHEN access_id % 4 < 3 THEN 'Event ' || access_id || ' stands out.' ELSE '' END AS threat_narrative,
  CASE WHEN access_id % 4 < 3 THEN 'rows,hour' ELSE '' END AS evidence,
  CASE WHEN access_id % 4 < 3 AND access_id % 3 = 0 THEN 'Quarantine'
    WHEN access_id % 4 < 3 AND access_id % 3 = 2 THEN 'Monitor' ELSE {ACTION} END AS recommended_action
FROM rp""")
def json_salvage(q: Inputs):
    parsed = responses.salvage(_responses(q), "answer", "anomaly_score")
    return parsed.select(
        "access_id", "is_json", "threat_narrative", F.array_join("evidence_list", ",").alias("evidence"),
        "recommended_action",
    )


@query("n5_embedded_object", """
WITH p AS (SELECT page_id, substr(html, instr(html, '{')) AS t FROM pages WHERE instr(html, '{') > 0),
c AS (SELECT page_id, i, substr(t, i, 1) AS c FROM (SELECT page_id, t, unnest(range(1, length(t) + 1)) AS i FROM p)),
s AS (SELECT *, sum((c = '"')::INT) OVER (PARTITION BY page_id ORDER BY i) % 2 = 1 AS quoted FROM c),
d AS (SELECT *, sum(CASE WHEN quoted THEN 0 WHEN c = '{' THEN 1 WHEN c = '}' THEN -1 ELSE 0 END)
        OVER (PARTITION BY page_id ORDER BY i) AS depth FROM s),
e AS (SELECT page_id, min(i) AS n FROM d WHERE depth = 0 GROUP BY page_id)
SELECT page_id, coalesce(substr(t, 1, n), '') AS found FROM pages LEFT JOIN p USING (page_id) LEFT JOIN e USING (page_id)""", prelude=False)
def embedded_object(q: Inputs):
    return q.table("pages").select("page_id", responses.embedded_object(col("html")).alias("found"))


@query("n6_missing_fields", """
SELECT CAST(access_id AS VARCHAR) AS access_id, CASE WHEN access_id % 2 = 0 THEN query_type ELSE 'SELECT' END AS query_type,
  CASE WHEN access_id % 3 = 0 THEN rowcount ELSE 0 END AS rowcount, 'local_workstation' AS destination, 'success' AS status,
  'low' AS data_sensitivity, time_classification
FROM fx_logs""")
def missing_fields(q: Inputs):
    partial = q.logs.select(
        F.to_json(
            F.struct(
                col("access_id").cast("string").alias("access_id"),
                "timestamp",
                F.when(col("access_id") % 2 == 0, col("query_type")).alias("query_type"),
                F.when(col("access_id") % 3 == 0, col("rowcount")).alias("rowcount"),
            )
        ).alias("value")
    )
    return ingest.parse_events(partial, "value").select(
        "access_id", "query_type", "rowcount", "destination", "status", "data_sensitivity", "time_classification"
    )
