"""Enrichment: logs and profiles to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions import features as fx
from wardline.operators.joins import attach_profiles, derive_profile_features, require_unique
from wardline.operators.windows import trailing_count
from wardline.schemas import FEATURES, IDS
from wardline.sources.readers import require_columns

VELOCITY = "Temporal_Velocity"
VELOCITY_SECONDS = 3600
LOG_INPUTS = [
    *IDS, "data_asset", "data_sensitivity", "query_type", "rowcount", "destination", "status",
    "source_ip", "authentication_method", "is_vpn", "geo_location", "time_classification",
]


def merge(logs: DataFrame, profiles: DataFrame, reference_date: str) -> DataFrame:
    """Every event with its profile and the profile's features; no event is lost or repeated."""
    return attach_profiles(logs, derive_profile_features(profiles, reference_date))


def event_features(merged: DataFrame) -> DataFrame:
    """All features of single events, in stages so that shared values are computed once."""
    scored = merged.withColumn(fx.SENSITIVITY, fx.sensitivity_score())
    staged = scored.withColumns({name: make() for name, make in fx.EVENT_STAGE.items()})
    compounds = {name: make() for name, make in fx.COMPOUND_STAGE.items()}
    return staged.withColumns(compounds).drop(fx.SENSITIVITY)


def with_velocity(df: DataFrame, logs: DataFrame) -> DataFrame:
    """Add the user's events in the trailing hour."""
    keys = logs.select("user_id", "timestamp")
    return trailing_count(df, keys, "user_id", "timestamp", "access_id", VELOCITY, VELOCITY_SECONDS)


def finish(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Ids and features in fixed order, as doubles, every remaining null as 0."""
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]
    return df.select(*IDS, *(extra or []), *numbers)


def enrich(
    logs: DataFrame,
    profiles: DataFrame,
    reference_date: str,
    extra: list[str] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """The feature table: one profile join, one shuffle for the trailing count.

    Only ids and numbers (and ``extra`` columns, if asked for) travel through that shuffle.
    ``profiles`` must have one row per user, as a second one would repeat events; that is checked first.
    ``keys`` are the same events where their users and times are cheaper to read than from ``logs``.
    """
    require_columns(logs, LOG_INPUTS, "access logs")
    require_unique(profiles, ["user_id"], "profiles")
    featured = event_features(merge(logs, profiles, reference_date))
    keep = [f for f in FEATURES if f != VELOCITY]
    slim = featured.select(*IDS, *(extra or []), *keep)
    return finish(with_velocity(slim, logs if keys is None else keys), extra)
