"""Joins of events with profiles, labels, context, dimensions and per-key statistics.

A side is broadcast only when the size of its tables has been checked. Otherwise it is a
sort-merge join, whose skewed partitions adaptive execution splits; joins that feed an aggregation
on the same key, where it cannot do that, are salted by ``join_statistics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline import dims
from wardline.functions import features as fx
from wardline.session import broadcast_if_small, input_bytes

PROFILE_CLASHES = ["username", "email", "department"]


def derive_profile_features(profiles: DataFrame, reference_date: str) -> DataFrame:
    """Profile columns plus the features that depend on the profile alone."""
    flags = {name: make() for name, make in fx.PROFILE_STAGE.items()}
    staged = profiles.withColumns(
        {
            **flags,
            "stale_account_days": fx.stale_account_days(reference_date),
            "approved_assets_count": F.size(fx.approved_assets()),
        }
    )
    return staged.withColumn("Tenure_Risk_Modifier", fx.tenure_risk_modifier())


def without_clashes(profiles: DataFrame) -> DataFrame:
    return profiles.drop(*PROFILE_CLASHES)


def attach_profiles(logs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every event, with its user's profile where there is one. ``profiles`` has one row per user."""
    return logs.join(broadcast_if_small(without_clashes(profiles)), "user_id", "left")


def orphan_events(logs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events whose user has no profile."""
    return logs.join(broadcast_if_small(profiles.select("user_id")), "user_id", "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, remaining columns breaking ties.

    A minimum over structs combines before the shuffle, so a key with very many copies costs no
    more than any other; a row_number window would gather all its copies in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    picked = df.groupBy(*keys).agg(packed).select(*keys, "_first.*")
    return picked.select(*df.columns)


SALT_CHECK_BYTES = 8 << 30
ROWS_PER_SALT = 5_000_000


def join_statistics(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    count: str,
    spread: list[str],
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Inner join of rows with one row of statistics per key, safe for keys with very many rows.

    ``count`` names the column of ``stats`` with the key's number of rows. A key with more than
    ``rows_per_salt`` rows is split: its statistics are repeated once per part, and its rows are
    dealt to the parts by a hash of the ``spread`` columns. At most rows / rows_per_salt keys are
    split, which bounds the broadcast list of them. Small inputs are joined directly.
    """
    if rows_per_salt is None:
        if input_bytes(rows) <= SALT_CHECK_BYTES:
            return rows.join(stats, keys)
        rows_per_salt = ROWS_PER_SALT
    parts = F.ceil(F.col(count) / rows_per_salt).cast("int")
    split = stats.where(F.col(count) > rows_per_salt).select(*keys, parts.alias("_parts"))
    dealt = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
    salted = rows.join(F.broadcast(split), keys, "left").withColumn(
        "_salt", F.coalesce(dealt, F.lit(0))
    )
    repeated = stats.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    )
    return salted.drop("_parts").join(repeated, [*keys, "_salt"]).drop("_salt")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Fail if a key has several rows; one aggregation over the keys."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{what} have several rows for one {', '.join(keys)}")


def with_labels(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Alerts with their ground truth; missing labels become an unknown, normal one.

    Of several labels of an event the first by value counts, so no alert is repeated.
    """
    lab = labels.select(
        "access_id",
        F.col("is_anomaly").alias("_is"),
        F.col("anomaly_type").alias("_type"),
        F.col("severity").alias("_sev"),
        F.col("explanation").alias("_why"),
    )
    first = first_per_key(lab, ["access_id"], ["_is", "_type", "_sev", "_why"])
    joined = alerts.join(first, "access_id", "left")
    return joined.withColumns(
        {
            "is_anomaly": F.coalesce("_is", F.lit(False)),
            "anomaly_type": F.coalesce("_type", F.lit("UNKNOWN")),
            "severity": F.coalesce("_sev", F.lit("NONE")),
            "explanation": F.coalesce("_why", F.lit("")),
        }
    ).drop("_is", "_type", "_sev", "_why")


CONTEXT = [
    "username", "department", "data_asset", "data_sensitivity", "query_type", "destination",
]


def with_context(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Alerts with the log columns an analyst reads; missing ones become "unknown".

    Of several log rows of an event the first by value counts, so no alert is repeated.
    """
    first = first_per_key(logs.select("access_id", *CONTEXT), ["access_id"], CONTEXT)
    joined = alerts.drop(*CONTEXT).join(first, "access_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in CONTEXT})


def with_asset_dimension(df: DataFrame, assets: DataFrame) -> DataFrame:
    """Sensitivity and category of ``data_asset`` from the catalogue, which is broadcast if its files are small."""
    return df.join(broadcast_if_small(assets), "data_asset", "left")


def with_feature_text(df: DataFrame, feature_col: str = "feature") -> DataFrame:
    """Title and explanation of a feature; unknown features get a title made from their name."""
    dim = dims.feature_dimension(df.sparkSession).withColumnRenamed("feature", feature_col)
    words = F.replace(F.col(feature_col), F.lit("_"), F.lit(" "))
    # a row for each of the fixed features
    return df.join(F.broadcast(dim), feature_col, "left").withColumns(
        {
            "display_name": F.coalesce("display_name", F.initcap(words)),
            "description": F.coalesce(
                "description", F.concat(F.lower(words), F.lit(" is out of the ordinary"))
            ),
        }
    )
