"""Streaming jobs: enrichment with the trailing hour, scoring, rates, reuse and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.numeric import round_to
from wardline.functions.text import content_hash, time_cell
from wardline.operators.attribution import BACKGROUND, background_rows, explain, top_features
from wardline.operators.forest import Forest
from wardline.operators.joins import require_unique
from wardline.operators.triage import TTL_SECONDS
from wardline.operators.windows import trailing_count
from wardline.plans.enrich import (
    VELOCITY, VELOCITY_SECONDS, event_features, finish, merge,
)
from wardline.plans.train import Trained
from wardline.schemas import FEATURES, IDS
from wardline.session import materialize
from wardline.sources.readers import feature_matrix
from wardline.streaming.trailing import trailing_stream, versions


def stateless_features(stream: DataFrame, profiles: DataFrame, reference_date: str) -> DataFrame:
    """All features but the trailing count; the same functions as in the batch job."""
    featured = event_features(merge(stream, profiles, reference_date))
    return featured.select(*IDS, *[f for f in FEATURES if f != VELOCITY])


def score_stream(
    stream: DataFrame,
    profiles: DataFrame,
    reference_date: str,
    out: str,
    checkpoint: str,
    model: Forest | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Enrich (and score) micro-batches into ``out``, partitioned by day and batch.

    The trailing count needs the hour before the batch. It is read back from what earlier batches
    wrote, for its users and the time it covers, and only from the days it touches, so neither state nor file listings grow with
    the age of the stream. A batch that is run again replaces its own partitions, which makes the
    sink exactly-once. An event that arrives late counts the events known by then; events already
    written are not revised; ``score_stream_revised`` does that. Profiles must have one row per user.
    """
    require_unique(profiles, ["user_id"], "profiles")
    features = stateless_features(stream, profiles, reference_date)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            seen = batch.withColumn("_new", F.lit(True))
            earlier = _written_before(batch, out, batch_id)
            if earlier is not None:
                seen = seen.unionByName(earlier.withColumn("_new", F.lit(False)), allowMissingColumns=True)
            counted = trailing_count(
                seen, seen.select("user_id", "timestamp"), "user_id", "timestamp", "access_id",
                VELOCITY, VELOCITY_SECONDS,
            )
            done = finish(counted.where("_new"))
            if model is not None:
                done = model.score(done)
            placed = done.withColumns(
                {"event_date": F.to_date("timestamp"), "batch_id": F.lit(batch_id)}
            )
            spread = placed.hint("rebalance", "event_date")
            writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("event_date", "batch_id").parquet(out)
        finally:
            batch.unpersist()

    writer = features.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream_revised(
    stream: DataFrame,
    profiles: DataFrame,
    reference_date: str,
    out: str,
    checkpoint: str,
    model: Forest | None = None,
    delay: str = "1 day",
    available_now: bool = False,
) -> StreamingQuery:
    """Enrich (and score) micro-batches into versions; an event that arrives late revises those it changes.

    The trailing count is exact state (``trailing.trailing_stream``), so events may come in any order within
    ``delay``. ``trailing.current`` reads the latest version of each event.
    """
    require_unique(profiles, ["user_id"], "profiles")
    others = [f for f in FEATURES if f != VELOCITY]
    # the state works row by row, so the features go through it as one value, in the type they end in
    packed = F.array(*[F.col(f).cast("double") for f in others]).alias("values_")
    features = stateless_features(stream, profiles, reference_date).select(*IDS, packed)
    counted = trailing_stream(features, "user_id", "timestamp", "access_id", VELOCITY, delay, VELOCITY_SECONDS)

    def whole(batch: DataFrame) -> DataFrame:
        done = finish(batch.withColumns({f: F.get("values_", F.lit(i)) for i, f in enumerate(others)}))
        return done if model is None else model.score(done)

    return versions(counted, "timestamp", out, checkpoint, available_now, whole)


def _days_touched(batch: DataFrame) -> list[str]:
    """Days of the batch's events and of the hour before them."""
    start = F.col("timestamp") - F.make_interval(secs=F.lit(VELOCITY_SECONDS))
    both = F.explode(F.array(F.to_date("timestamp"), F.to_date(start)))
    days = batch.where("timestamp IS NOT NULL").select(both.alias("d")).distinct()
    return sorted(str(r["d"]) for r in days.collect())


def _written_before(batch: DataFrame, out: str, batch_id: int) -> DataFrame | None:
    """Ids of the events that earlier batches stored for this batch's users, from the hour before it on.

    Only folders of days that the batch touches are listed, and of them the time range is pushed to the files.
    """
    spark = batch.sparkSession
    paths = [f"{out}/event_date={day}" for day in _days_touched(batch)]
    paths = [p for p in paths if _exists(spark, p)] if batch_id else []
    if not paths:
        return None
    first, last = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
    since = F.lit(first) - F.make_interval(secs=F.lit(VELOCITY_SECONDS))
    stored = spark.read.option("basePath", out).parquet(*paths)
    near = stored.where((F.col("batch_id") < batch_id) & (F.col("timestamp") > since) & (F.col("timestamp") <= F.lit(last)))
    return near.select(*IDS).join(batch.select("user_id").distinct(), "user_id", "left_semi").select(*IDS)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def event_rates(
    stream: DataFrame, keys: list[str], size: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour"
) -> DataFrame:
    """Events per sliding window and key; late rows up to ``delay`` are still counted."""
    w = F.window("timestamp", size, slide)
    counted = stream.withWatermark("timestamp", delay).groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("n")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"
    )


def without_repeats(
    stream: DataFrame, content: list[str], ttl_seconds: int = TTL_SECONDS
) -> DataFrame:
    """Keep the first event of each content and interval; it is evaluated for the others.

    Same intervals as the batch job. They also bound the state: a key is dropped once the
    watermark has passed it, and cannot come back.
    """
    keyed = stream.withColumns(
        {
            "event_hash": content_hash(content),
            "ttl_cell": time_cell(F.col("timestamp"), ttl_seconds),
        }
    )
    timed = keyed.withWatermark("timestamp", f"{ttl_seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(["event_hash", "ttl_cell"])


def session_stream(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions per user, closed once the watermark passes their end."""
    s = F.session_window("timestamp", gap)
    counted = stream.withWatermark("timestamp", delay).groupBy("user_id", s.alias("s")).agg(
        F.count("*").alias("events")
    )
    return counted.select(
        "user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"
    )


def evaluated(events: DataFrame, trained: Trained) -> DataFrame:
    """Response to each event: flag, rounded score, what speaks for it if it is flagged, time of analysis.

    Features that an event lacks, as a column or a value, count as 0. Only flagged events are explained, the others
    have an empty list. The scored events are stored, as both parts read them.
    """
    given = {f: F.lit(0.0) for f in FEATURES if f not in events.columns}
    model = trained.model
    scored = materialize(model.score(feature_matrix(events.withColumns(given))), "evaluated")
    reference = background_rows(trained.enriched, model, "access_id", BACKGROUND)
    hits = explain(scored.where("prediction = -1"), model, reference)
    hits = hits.withColumn("top_features", top_features(F.col("attribution"))).drop("attribution")
    none = F.array().cast(hits.schema["top_features"].dataType)
    others = scored.where("prediction <> -1 OR prediction IS NULL").withColumn("top_features", none)
    return hits.unionByName(others).select(
        "access_id",
        "user_id",
        (F.col("prediction") == -1).alias("is_anomaly"),
        round_to("anomaly_score", 6).alias("anomaly_score"),
        "prediction",
        "top_features",
        F.current_timestamp().alias("analyzed_at"),
    )


def whole_rates(
    stream: DataFrame, rows: DataFrame, keys: list[str], out: str, checkpoint: str,
    size: str = "1 hour", slide: str = "5 minutes", delay: str = "1 hour",
) -> DataFrame:
    """The closed windows of the stream, and those still open from the same ``rows`` in batch form."""
    closed, mark = run_to_watermark(event_rates(stream, keys, size, slide, delay), out, checkpoint)
    recent = rows.where(F.col("timestamp") > mark - F.expr(f"INTERVAL {size}"))
    still = event_rates(recent, keys, size, slide, delay).where(F.col("window_end") > mark)
    return closed.unionByName(still)


def whole_sessions(
    stream: DataFrame, rows: DataFrame, out: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 hour"
) -> DataFrame:
    """The closed sessions of the stream, and those still open from all ``rows`` of their users in batch form."""
    closed, mark = run_to_watermark(session_stream(stream, gap, delay), out, checkpoint)
    recent = rows.where(F.col("timestamp") > mark - F.expr(f"INTERVAL {gap}"))
    users = recent.select(F.col("user_id").alias("_user")).distinct()
    theirs = rows.join(users, F.col("user_id").eqNullSafe(F.col("_user")), "left_semi")
    still = session_stream(theirs, gap, delay).where(F.col("session_end") > mark)
    return closed.unionByName(still)


def run_to_watermark(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, Column]:
    """The table of a stream that has run to its end, and the watermark up to which it is closed.

    The mark is that of the batches which the checkpoint has as committed, so a run without new data finds the
    same one as the run before it.
    """
    _run(stream, out, checkpoint)
    spark = stream.sparkSession
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)$", 1)
    planned = spark.read.text(f"{checkpoint}/offsets").select(number.alias("batch"), "value")
    done = spark.read.text(f"{checkpoint}/commits").select(number.alias("batch")).distinct()
    marks = planned.join(done, "batch").select(F.get_json_object("value", "$.batchWatermarkMs").cast("long").alias("ms"))
    mark = F.timestamp_millis(F.lit(marks.agg(F.max("ms")).first()[0] or 0).cast("long"))
    return spark.read.schema(stream.schema).parquet(out), mark


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything that is available now into a Parquet table and return it."""
    _run(stream, out, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query
