"""Row predicates and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import dims
from wardline.functions.features import is_external_ip
from wardline.functions.text import clean

STALE_COHORT_DAYS = 50


def predicted_anomalies(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("prediction") == -1)


def by_severity(df: DataFrame, wanted: str) -> DataFrame:
    """ALL keeps every row; otherwise the ground-truth severity must match."""
    return df if wanted == "ALL" else df.where(F.col("severity") == wanted)


def cohorts(end_date: str) -> dict[str, Column]:
    """Predicates of the user groups that anomalies are drawn from."""
    tier = clean(F.col("access_tier"))
    oldest = F.date_sub(F.lit(end_date).cast("date"), STALE_COHORT_DAYS)
    return {
        "high_risk": F.col("high_risk_flag"),
        "stale": F.col("last_access_date") < oldest,
        "on_notice": F.col("notice_period"),
        "junior": tier.isin("junior", "standard"),
        "contractor": tier == "contractor",
    }


def marked_events(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("anomaly_marker").isNotNull() & (F.col("anomaly_marker") != ""))


def night_events(logs: DataFrame) -> DataFrame:
    hour = F.hour("timestamp")
    return logs.where((hour >= 22) | (hour <= 6))


def exposure_flags(logs: DataFrame) -> DataFrame:
    return logs.withColumns(
        {
            "external_ip": is_external_ip(),
            "external_destination": clean(F.col("destination")).isin(dims.EXTERNAL_DESTINATIONS),
            "suspicious_geo": clean(F.col("geo_location")).isin(dims.SUSPICIOUS_GEO),
        }
    )


def is_senior_title() -> Column:
    return F.col("job_title").rlike("|".join(dims.SENIOR_WORDS))
