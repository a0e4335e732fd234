"""The model and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.numeric import round_to
from wardline.catalog.basics import CONTENT, HASH
from wardline.catalog.registry import FEATURE_LIST, Inputs, query, time_text
from wardline.functions.text import content_hash, time_cell
from wardline.operators import attribution, evaluate, filters, forest, triage
from wardline.plans import alerts as alert_plan, train as train_plan
from wardline.schemas import FEATURES
from wardline.session import fresh_path, materialize
from wardline.sources import model_store, sample_views as views, writers
from wardline.streaming import ingest, jobs, trailing, watch

col = F.col

# --- forest ------------------------------------------------------------------------------


@query("m2_forest")
def fitted_forest(q: Inputs):
    """Shape of each fitted tree."""
    nodes = q.spark.createDataFrame(q.trained.model.nodes, forest.NODES)
    return nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"),
        F.max("depth").cast("long").alias("height"),
        F.sum(F.when(col("feature") < 0, col("rows"))).alias("rows_in_leaves"),
    )


@query("m2_tree_samples", """
SELECT CAST(t AS INTEGER) AS tree, least(256, (SELECT count(*) FROM events)) AS rows,
  least(256, (SELECT count(DISTINCT event_id) FROM events)) AS distinct_rows FROM (SELECT unnest(range(200)) AS t)""", prelude=False)
def tree_samples(q: Inputs):
    """Rows drawn per tree, checked against the subsample size."""
    return _drawn(q).groupBy("tree").agg(
        F.count("*").alias("rows"), F.countDistinct("access_id").alias("distinct_rows")
    )


def _drawn(q: Inputs):
    return forest.tree_samples(q.logs.select("access_id"), "access_id", forest.TREES, forest.SUBSAMPLE, forest.SEED)


@query("m2_sampled_ids", f"""
WITH t AS (SELECT t, (({forest.SEED << 20} + t + 1)::UHUGEINT * {forest.GOLDEN}) % 18446744073709551616 AS shift FROM (SELECT unnest(range({forest.TREES})) AS t)),
a AS (SELECT t, event_id, ((event_id::UHUGEINT + shift) % 18446744073709551616)::UBIGINT AS x FROM events, t),
b AS (SELECT t, event_id, ((xor(x, x >> 32)::UHUGEINT * {forest.MIX}) % 18446744073709551616)::UBIGINT AS x FROM a),
c AS (SELECT t, event_id, ((xor(x, x >> 29)::UHUGEINT * {forest.MIX}) % 18446744073709551616)::UBIGINT AS x FROM b),
d AS (SELECT t, event_id, row_number() OVER (PARTITION BY t ORDER BY xor(x, x >> 32) >> 1, event_id) AS k FROM c)
SELECT t::INTEGER AS tree, event_id AS access_id FROM d WHERE k <= {forest.SUBSAMPLE}""", prelude=False)
def sampled_ids(q: Inputs):
    """The events each tree is grown on: the lowest picks of the whole table."""
    return _drawn(q).select("tree", "access_id")


@query("m3_scores")
def scores(q: Inputs):
    return q.trained.scored().select("access_id", "anomaly_score", "prediction")


@query("m4_model_threshold")
def model_threshold(q: Inputs):
    """Share of training events below the threshold, next to the wanted contamination."""
    scored = q.trained.scored()
    return scored.agg(
        F.lit(q.trained.model.offset).alias("offset"),
        F.avg((col("prediction") == -1).cast("double")).alias("share"),
        F.lit(forest.CONTAMINATION).alias("wanted"),
    )


@query("m5_retrain")
def retrain(q: Inputs):
    return train_plan.retrain(
        q.spark, q.logs, q.profiles, q.labels, views.REFERENCE_DATE, fresh_path(q.spark, "model")
    )


@query("m5_model_metrics")
def model_metrics(q: Inputs):
    # both sides grow with the events; a size guessed from compressed files must not have one broadcast
    return evaluate.metrics(evaluate.labelled(q.trained.scored(), q.stored_labels.hint("merge")))


@query("m6_version_agreement")
def version_agreement(q: Inputs):
    """A second version with another seed against the first."""
    table = q.trained.enriched
    other, _ = forest.fit_forest(table, "access_id", FEATURES, seed=7)
    return forest.version_agreement(table, q.trained.model, other)


@query("s8_model_store", """
SELECT count(*) AS compared, count(*) AS equal, 1.0::DOUBLE AS match_rate FROM events""", prelude=False)
def stored_model(q: Inputs):
    """A saved and reloaded model must predict the same."""
    path = fresh_path(q.spark, "model")
    model_store.save_forest(q.trained.model, path)
    reloaded = model_store.load_forest(q.spark, path)
    return forest.version_agreement(q.trained.enriched, q.trained.model, reloaded)


# --- attribution -------------------------------------------------------------------------


@query("m7_attribution")
def attributions(q: Inputs):
    top = alert_plan.explained_anomalies(q.trained, triage.MIN_COMPUTED)
    return top.select("access_id", "anomaly_score", F.inline("attribution"))


@query("m8_global_importance")
def global_importance(q: Inputs):
    """Importance over all events against 100 background rows."""
    reference = attribution.background_rows(q.trained.enriched, q.trained.model, "access_id", 100)
    return attribution.global_importance(attribution.explain(q.trained.enriched, q.trained.model, reference))


@query("m9_evaluate_events")
def evaluate_events(q: Inputs):
    """Every event as a request, evaluated anew: flag, score, explanation of hits and time of analysis."""
    return jobs.evaluated(q.enriched, q.trained)


@query("m10_seeded_sample")
def seeded_sample(q: Inputs):
    return forest.seeded_sample(q.logs.select("access_id", "user_id"), "access_id", 100)


@query("k1_model_alerts")
def model_alerts(q: Inputs):
    return triage.most_anomalous(q.trained.scored(), 50).select("access_id", "anomaly_score")


@query("p4_model_anomalies")
def model_anomalies(q: Inputs):
    return filters.predicted_anomalies(q.trained.scored()).select("access_id", "anomaly_score")


@query("t1_alerts")
def alerts(q: Inputs):
    return alert_plan.flagged_events(q.trained, q.logs, q.stored_labels)


@query("s9_alert_json")
def alert_json(q: Inputs):
    return writers.alerts_as_json(alert_plan.flagged_events(q.trained, q.logs, q.stored_labels, limit=20))


# --- streams -----------------------------------------------------------------------------


def _log_stream(q: Inputs):
    """The events table as a file stream, mapped like the batch view."""
    schema = q.table("events").schema
    raw = ingest.log_files(q.spark, q.sf_dir, schema, pathGlobFilter="events.parquet")
    return views.logs_from(raw, q.table("customer"))


def _paths(q: Inputs, label: str) -> tuple[str, str]:
    return fresh_path(q.spark, label), fresh_path(q.spark, f"{label}_checkpoint")


@query("r1_stream_ingest", """
SELECT access_id, user_id, query_type, destination, status, time_classification FROM fx_logs""")
def stream_ingest(q: Inputs):
    slim = _log_stream(q).select(
        "access_id", "user_id", "query_type", "destination", "status", "time_classification"
    )
    return jobs.run_to_table(slim, *_paths(q, "ingested"))


@query("r2_stream_features", f"SELECT access_id, {FEATURE_LIST} FROM fe")
def stream_features(q: Inputs):
    out, checkpoint = _paths(q, "stream_features")
    run = jobs.score_stream(
        _log_stream(q), q.profiles, views.REFERENCE_DATE, out, checkpoint, available_now=True
    )
    run.awaitTermination()
    return q.spark.read.option("basePath", out).parquet(out).select("access_id", *FEATURES)


@query("r2_revised_features", f"SELECT access_id, {FEATURE_LIST} FROM fe")
def revised_features(q: Inputs):
    """The events in three micro-batches in no order of time: late ones revise those they change."""
    out, checkpoint = _paths(q, "revised")
    arriving = fresh_path(q.spark, "arriving")
    for i in range(3):  # each run goes on from the checkpoint and takes what has arrived since as one micro-batch
        q.logs.where(F.pmod(F.hash("access_id"), F.lit(3)) == i).write.mode("append").parquet(arriving)
        stream = ingest.log_files(q.spark, arriving, q.logs.schema)
        run = jobs.score_stream_revised(
            stream, q.profiles, views.REFERENCE_DATE, out, checkpoint, delay="36500 days", available_now=True
        )
        run.awaitTermination()
    return trailing.current(q.spark, out, "access_id").select("access_id", *FEATURES)


@query("r2_event_rates", """
, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) - INTERVAL 5 MINUTE * i AS s, status FROM fx_logs, (SELECT unnest(range(12)) AS i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_rates(q: Inputs):
    """Sliding hourly rates: closed windows from the stream, open ones added."""
    slim = _log_stream(q).select("timestamp", "status")
    out = jobs.whole_rates(slim, q.logs.select("timestamp", "status"), ["status"], *_paths(q, "rates"))
    return out.select(time_text("window_start"), "status", "n")


@query("r3_stream_scoring")
def stream_scoring(q: Inputs):
    out, checkpoint = _paths(q, "stream_scores")
    run = jobs.score_stream(
        _log_stream(q), q.profiles, views.REFERENCE_DATE, out, checkpoint,
        model=q.trained.model, available_now=True,
    )
    run.awaitTermination()
    stored = q.spark.read.option("basePath", out).parquet(out)
    return stored.select("access_id", "anomaly_score", "prediction")


@query("r4_stream_reuse", f"""
SELECT DISTINCT {HASH} AS event_hash, epoch_us(timestamp) // 3600000000 AS ttl_cell FROM fx_logs""")
def stream_reuse(q: Inputs):
    first = jobs.without_repeats(_log_stream(q), CONTENT)
    return jobs.run_to_table(first.select("event_hash", "ttl_cell"), *_paths(q, "unrepeated"))


@query("r5_stream_sessions", """
, g AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR timestamp - lag(timestamp) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS o
    FROM fx_logs WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, access_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY timestamp, access_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, sid""")
def stream_sessions(q: Inputs):
    """Sessions: closed ones from the stream, open ones added."""
    slim = _log_stream(q).select("user_id", "timestamp")
    out = jobs.whole_sessions(slim, q.logs.select("user_id", "timestamp"), *_paths(q, "sessions"))
    return out.select("user_id", time_text("session_start"), "events")


@query("d17_watch_stream", """
, m AS (SELECT DISTINCT user_id, decided_at FROM decisions WHERE decision = 'Monitor')
SELECT l.access_id, l.user_id, strftime(max(decided_at), '%Y-%m-%d %H:%M:%S') AS watched_since FROM fx_logs l
JOIN m ON l.user_id = m.user_id AND l.timestamp BETWEEN decided_at AND decided_at + INTERVAL 48 HOUR GROUP BY 1, 2""")
def watch_stream(q: Inputs):
    """The watch list from two streams: settled events from the stream, open ones added."""
    path = fresh_path(q.spark, "decision_log")
    q.decisions.write.parquet(path)
    log = q.spark.readStream.schema(q.decisions.schema).parquet(path)
    out = watch.whole_watch(_log_stream(q), log, q.logs, q.decisions, *_paths(q, "watch"))
    return out.select("access_id", "user_id", time_text("watched_since"))


@query("t6_response")
def responses(q: Inputs):
    """Scored requests with reuse: one evaluation per content, copies marked."""
    requests = q.spread_logs.select(
        "access_id",
        "timestamp",
        content_hash(CONTENT).alias("event_hash"),
        time_cell(col("timestamp"), triage.TTL_SECONDS).alias("ttl_cell"),
    )
    hashed = materialize(requests, "hashed")  # read twice, hashed once
    picked = triage.one_per_content(hashed, "event_hash", "timestamp", ["access_id"])
    once = picked.select("event_hash", "ttl_cell", F.col("access_id").alias("evaluated_as"))
    scored = q.trained.scored().select(
        F.col("access_id").alias("evaluated_as"), "anomaly_score", "prediction"
    )
    answered = hashed.join(once, ["event_hash", "ttl_cell"]).join(scored, "evaluated_as")
    return answered.select(
        "access_id",
        (col("prediction") == -1).alias("is_anomaly"),
        round_to("anomaly_score", 6).alias("anomaly_score"),
        (col("access_id") != col("evaluated_as")).alias("reused"),
        F.current_timestamp().alias("analyzed_at"),
    )
