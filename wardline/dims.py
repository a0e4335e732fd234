"""Risk dimensions. Every lookup value of the engine is stated here and nowhere else.

The entries below are fixed values: results depend on them literally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Risk weight of the place data is sent to.
DESTINATION_RISK = {
    "usb_drive": 3,
    "external_email": 3,
    "personal_device": 3,
    "cloud_storage": 2,
    "print": 2,
    "shared_drive": 1,
    "internal_report": 0,
    "internal_server": 0,
    "local_workstation": 0,
}

# Risk weight of the query type.
QUERY_RISK = {
    "export": 3,
    "bulk_download": 3,
    "delete": 2,
    "update": 1,
    "insert": 1,
    "select": 0,
}

# Privilege score of the access tier (other tiers score TIER_DEFAULT).
TIER_SCORE = {"junior": 1, "contractor": 1, "standard": 2, "senior": 3, "admin": 4}
TIER_DEFAULT = 2

# Sensitivity of the data (unknown counts as SENSITIVITY_DEFAULT).
SENSITIVITY_SCORE = {"low": 1, "medium": 2, "high": 3, "restricted": 4}
SENSITIVITY_DEFAULT = 1

# Weight of the time class.
TIME_WEIGHT = {
    "night": 3,
    "weekend": 2,
    "after_hours": 2,
    "early_morning": 1,
    "business_hours": 0,
}

# Value sets used by the predicates.
SUSPICIOUS_GEO = ["pyongyang", "tor_exit_node", "unknown_vpn", "lagos", "caracas"]
WEAK_AUTH = ["password_only", "api_key"]
HIGH_SENSITIVITY = ["high", "restricted"]
OFF_HOURS = ["night", "weekend", "after_hours", "early_morning"]
EXTERNAL_DESTINATIONS = ["external_email", "usb_drive", "cloud_storage", "personal_device"]
RISKY_DESTINATIONS = ["external_email", "usb_drive", "cloud_storage", "personal_device", "print"]
EXPORT_QUERIES = ["export", "bulk_download"]
SENIOR_WORDS = [
    "Senior", "Manager", "Director", "VP", "Lead", "Principal",
    "Chief", "CEO", "COO", "CTO", "CFO", "CHRO",
]

# Severity of each event anomaly type, most severe first.
ANOMALY_SEVERITY = {
    "NIGHT_BULK_CRITICAL": "CRITICAL",
    "EXFILTRATION_RISK": "CRITICAL",
    "PRE_RESIGNATION_DOWNLOAD": "CRITICAL",
    "BULK_EXPORT": "HIGH",
    "AFTER_HOURS_RESTRICTED": "HIGH",
    "STALE_ACCOUNT_ACCESS": "HIGH",
    "PRIVILEGE_ESCALATION": "HIGH",
    "CROSS_DEPT_ACCESS": "MEDIUM",
    "DEVICE_ANOMALY": "MEDIUM",
    "FAILED_AUTH_BURST": "MEDIUM",
}

# Reader-facing wording of each feature: (title, explanation).
FEATURE_TEXT = {
    "tenure_months": ("Time in Company", "how long the person has worked here"),
    "high_risk_flag": ("Personnel Risk Mark", "the personnel department has marked this person as a risk"),
    "notice_period_flag": ("On Notice", "the person has resigned or been given notice"),
    "failed_logins_30d": ("Recent Login Failures", "login attempts that failed within the last month"),
    "stale_account_days": ("Dormant Days", "days without use before this access"),
    "approved_assets_count": ("Approved Assets", "size of the list of assets the person may use"),
    "Tenure_Risk_Modifier": ("Tenure Weight", "short service and personnel marks taken together"),
    "Equipment_Risk_Score": ("Equipment Risk", "the device or network address is not a managed one"),
    "Access_Tier_Mismatch": ("Tier Gap", "the data is more sensitive than the person's tier allows for"),
    "Cross_Dept_Access_Flag": ("Unapproved Asset", "the asset is missing from the person's approved list"),
    "Rowcount_Deviation": ("Volume Above Normal", "far more rows were read than this person usually reads"),
    "Exfiltration_Dest_Score": ("Risky Destination", "the data went to a place that is hard to control"),
    "Query_Type_Risk": ("Risky Operation", "the kind of operation removes or changes data in bulk"),
    "Weak_Auth_Flag": ("Weak Sign-In", "one factor or a static key was used to sign in"),
    "Suspicious_Geo_Flag": ("Unusual Place", "the access came from a watched location"),
    "VPN_Mismatch": ("VPN Habit Broken", "VPN use does not fit what is on file for this person"),
    "Temporal_Velocity": ("Access Burst", "many accesses by the same person within one hour"),
    "After_Hours_High_Sensitivity": ("Sensitive Data Off Hours", "sensitive data was opened outside working hours"),
    "Failed_Action_Flag": ("Failed Attempt", "the attempted action did not succeed"),
    "Cross_Dept_Sensitivity": ("Unapproved Sensitive Asset", "an unapproved asset, weighted by how sensitive it is"),
    "Time_Sensitivity_Risk": ("Odd Hour by Sensitivity", "the hour of access, weighted by how sensitive the data is"),
    "Stale_Sensitivity_Risk": ("Dormant Account on Sensitive Data", "a long unused account opened sensitive data"),
    "Volume_Dest_Compound": ("Volume to Risky Destination", "an unusual volume went to a risky destination"),
}


def score_of(key: Column, scores: dict[str, int], default: int) -> Column:
    """Look a normalised key up in a small score table; unknown keys give ``default``.

    One IN-set test per distinct score, so the lookup stays inside generated code.
    """
    by_score: dict[int, list[str]] = {}
    for name, score in scores.items():
        by_score.setdefault(score, []).append(name)
    branches = [(key.isin(names), score) for score, names in by_score.items() if score != default]
    first, *rest = branches
    chain = reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))
    return chain.otherwise(default)


def feature_dimension(spark: SparkSession) -> DataFrame:
    """Feature wording as a table (feature, display_name, description)."""
    rows = [(f, name, text) for f, (name, text) in FEATURE_TEXT.items()]
    return spark.createDataFrame(rows, "feature string, display_name string, description string")
