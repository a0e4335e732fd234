"""Analyst decisions: the log, its weekly patterns, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.windows import MICROS, last_before, micros

DECISIONS = ["Quarantine", "Monitor", "False Positive"]
WATCH_HOURS = 48


def record_decisions(decisions: DataFrame, path: str) -> None:
    """Append (access_id, user_id, decided_at, decision, analyst) to the log; nothing is rewritten."""
    unknown = ~F.col("decision").isin(DECISIONS)
    checked = decisions.withColumn(
        "decision", F.when(unknown, F.raise_error(F.lit("unknown decision"))).otherwise(F.col("decision"))
    ).withColumn("decided_on", F.to_date("decided_at"))
    checked.write.mode("append").partitionBy("decided_on").parquet(path)


def weekly_false_positives(decisions: DataFrame, pattern: list[str]) -> DataFrame:
    """Dismissed alerts per week and pattern."""
    week = F.window(F.col("decided_at").cast("timestamp"), "7 days")
    dismissed = decisions.where(F.col("decision") == "False Positive")
    counted = dismissed.groupBy(week.alias("w"), *pattern).agg(
        F.count("*").alias("dismissed"), F.countDistinct("user_id").alias("users")
    )
    return counted.select(F.to_date("w.start").alias("week_from"), *pattern, "dismissed", "users")


def training_feedback(enriched: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows for the next training run: everything except accesses confirmed as hostile."""
    hostile = decisions.where(F.col("decision") == "Quarantine").select("access_id")
    return enriched.join(hostile, "access_id", "left_anti")


def watch_list(logs: DataFrame, decisions: DataFrame, hours: int = WATCH_HOURS) -> DataFrame:
    """Events of a user in the ``hours`` after a Monitor decision.

    Only the latest decision before an event matters, so no event-decision pairs are formed. A decision without a user
    watches nobody.
    """
    monitored = decisions.where((F.col("decision") == "Monitor") & F.col("user_id").isNotNull()).select(
        "user_id", F.col("decided_at").alias("timestamp")
    )
    seen = last_before(logs, monitored, "user_id", "timestamp", "watched_since")
    age = micros(F.col("timestamp")) - micros(F.col("watched_since"))
    return seen.where(age <= hours * 3600 * MICROS)
