"""Fixed schemas of the input tables and the order of the model features."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in spec])


_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

LOGS = _struct(
    [
        ("access_id", _S),
        ("timestamp", T.TimestampType()),
        ("user_id", _S),
        ("username", _S),
        ("department", _S),
        ("data_asset", _S),
        ("data_sensitivity", _S),
        ("data_category", _S),
        ("query_type", _S),
        ("rowcount", _L),
        ("access_method", _S),
        ("destination", _S),
        ("status", _S),
        ("source_ip", _S),
        ("bytes_transferred", _L),
        ("session_duration_min", _D),
        ("client_application", _S),
        ("authentication_method", _S),
        ("is_vpn", _B),
        ("geo_location", _S),
        ("time_classification", _S),
        ("anomaly_marker", _S),
    ]
)

PROFILES = _struct(
    [
        ("user_id", _S),
        ("username", _S),
        ("email", _S),
        ("department", _S),
        ("job_title", _S),
        ("access_tier", _S),
        ("tenure_months", _I),
        ("approved_data_assets", _S),
        ("avg_queries_per_day", _D),
        ("typical_access_hours", _S),
        ("avg_rowcount_per_query", _I),
        ("high_risk_flag", _B),
        ("equipment", _S),
        ("clearance_level", _S),
        ("notice_period", _B),
        ("last_performance_rating", _D),
        ("security_training_current", _B),
        ("failed_logins_30d", _I),
        ("vpn_user", _B),
        ("last_access_date", T.DateType()),
    ]
)

USER_LABELS = _struct(
    [
        ("user_id", _S),
        ("is_anomaly", _B),
        ("risk_type", _S),
        ("severity", _S),
        ("explanation", _S),
    ]
)

EVENT_LABELS = _struct(
    [
        ("access_id", _S),
        ("is_anomaly", _B),
        ("anomaly_type", _S),
        ("severity", _S),
        ("explanation", _S),
    ]
)

IDS = ["access_id", "user_id", "timestamp"]

# The model's feature names in the order of its input vector.
FEATURES = [
    "tenure_months",
    "high_risk_flag",
    "notice_period_flag",
    "failed_logins_30d",
    "stale_account_days",
    "approved_assets_count",
    "Tenure_Risk_Modifier",
    "Equipment_Risk_Score",
    "Access_Tier_Mismatch",
    "Cross_Dept_Access_Flag",
    "Rowcount_Deviation",
    "Exfiltration_Dest_Score",
    "Query_Type_Risk",
    "Weak_Auth_Flag",
    "Suspicious_Geo_Flag",
    "VPN_Mismatch",
    "Temporal_Velocity",
    "After_Hours_High_Sensitivity",
    "Failed_Action_Flag",
    "Cross_Dept_Sensitivity",
    "Time_Sensitivity_Risk",
    "Stale_Sensitivity_Risk",
    "Volume_Dest_Compound",
]

ENRICHED = _struct(
    [("access_id", _S), ("user_id", _S), ("timestamp", T.TimestampType())]
    + [(f, _D) for f in FEATURES]
)
