"""The watch list on a stream: events joined with the Monitor decisions before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.feedback import WATCH_HOURS, watch_list


def watch_stream(logs: DataFrame, decisions: DataFrame, delay: str = "1 day", hours: int = WATCH_HOURS) -> DataFrame:
    """access_id, user_id, timestamp and watched_since of every event, once it can't change any more.

    Both inputs are streams (or tables) and may be late by ``delay``. An event waits until no decision before it can
    arrive; a decision is kept until no event within its ``hours`` can. Spark derives both bounds from the condition
    and the watermarks, so state does not grow with the age of the stream. ``watched_since`` is the latest Monitor
    decision of the user in the ``hours`` up to the event; it is null for an event that nobody watches, which comes
    out when it expires. Events without a time are left out, a repeated event or decision counts once, and an event
    without a user is not watched. Output is in append mode.
    """
    events = logs.select("access_id", "user_id", "timestamp").where("timestamp IS NOT NULL")
    monitored = decisions.where("decision = 'Monitor' AND decided_at IS NOT NULL AND user_id IS NOT NULL").select(
        F.col("user_id").alias("watched_user"), F.col("decided_at").cast("timestamp").alias("decided_at")
    )
    events = events.withWatermark("timestamp", delay)
    monitored = monitored.withWatermark("decided_at", delay)
    met = events.join(
        monitored,
        F.expr(
            f"user_id = watched_user AND timestamp >= decided_at AND timestamp <= decided_at + INTERVAL {int(hours)} HOURS"
        ),
        "left_outer",
    )
    # as a number the decision's time has no watermark of its own, so the event's alone decides when a group is done
    since = met.select("access_id", "user_id", "timestamp", F.unix_micros("decided_at").alias("since"))
    latest = since.groupBy("access_id", "user_id", "timestamp").agg(F.max("since").alias("since"))
    return latest.select("access_id", "user_id", "timestamp", F.timestamp_micros("since").alias("watched_since"))


def whole_watch(
    stream: DataFrame, decision_stream: DataFrame, logs: DataFrame, decisions: DataFrame, out: str, checkpoint: str,
    delay: str = "1 day",
) -> DataFrame:
    """Watched events of a finished source: what the stream has settled, and the events still open by the batch form."""
    settled = watch_stream(stream, decision_stream, delay)
    writer = settled.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    done = logs.sparkSession.read.schema(settled.schema).parquet(out)
    slim = logs.select("access_id", "user_id", "timestamp")
    open_events = slim.join(done.select("access_id"), "access_id", "left_anti")
    return done.where("watched_since IS NOT NULL").unionByName(watch_list(open_events, decisions))
