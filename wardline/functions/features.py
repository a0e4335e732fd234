"""The risk features, one Column function each. No function runs a job or a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardline.functions.numeric import round_to
from wardline import dims
from wardline.functions.text import clean, in_list, pipe_list, truthy

col = F.col


# --- features of the profile -------------------------------------------------------------


def high_risk_flag() -> Column:
    return truthy(col("high_risk_flag"))


def notice_period_flag() -> Column:
    return truthy(col("notice_period"))


def stale_account_days(reference_date: str) -> Column:
    """Whole days between the last access and the reference date, never negative."""
    days = F.datediff(F.lit(reference_date).cast("date"), col("last_access_date"))
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0))


def approved_assets() -> Column:
    return pipe_list(col("approved_data_assets"))


def tenure_risk_modifier() -> Column:
    """Expects ``high_risk_flag`` already as 0/1; null tenure falls through to 1.0."""
    new = col("tenure_months") < 6
    settled = col("tenure_months") >= 6
    risk = col("high_risk_flag") == 1
    return F.when(new & risk, 3.0).when(new, 1.5).when(settled & risk, 2.0).otherwise(1.0)


# --- features of the event ---------------------------------------------------------------


# Name of the column that holds ``sensitivity_score`` for the features below.
SENSITIVITY = "_sensitivity"


def sensitivity_score() -> Column:
    level = clean(col("data_sensitivity"), "low")
    return dims.score_of(level, dims.SENSITIVITY_SCORE, dims.SENSITIVITY_DEFAULT)


def is_high_sensitivity() -> Column:
    return clean(col("data_sensitivity")).isin(dims.HIGH_SENSITIVITY)


def is_external_ip() -> Column:
    """Anything outside 10.*; a missing address counts as external."""
    return ~F.coalesce(col("source_ip"), F.lit("")).startswith("10.")


def equipment_risk_score() -> Column:
    contractor = clean(col("equipment")) == "contractor_machine"
    return (
        F.when(contractor, F.when(col(SENSITIVITY) >= 3, 2).otherwise(1))
        .when(is_external_ip(), 2)
        .otherwise(0)
    )


def access_tier_mismatch() -> Column:
    tier = dims.score_of(
        clean(col("access_tier"), "standard"), dims.TIER_SCORE, dims.TIER_DEFAULT
    )
    return F.greatest(col(SENSITIVITY) - tier, F.lit(0))


def cross_dept_access_flag() -> Column:
    """Expects ``approved_assets`` as a clean list; no list or a blank asset is a mismatch."""
    return F.when(in_list(col("approved_assets"), col("data_asset")), 0).otherwise(1)


def rowcount_deviation() -> Column:
    usual = F.greatest(
        F.coalesce(col("avg_rowcount_per_query").cast("double"), F.lit(1.0)), F.lit(1.0)
    )
    ratio = F.coalesce(col("rowcount").cast("double"), F.lit(0.0)) / usual
    return round_to(ratio, 4)


def exfiltration_dest_score() -> Column:
    return dims.score_of(clean(col("destination")), dims.DESTINATION_RISK, 0)


def query_type_risk() -> Column:
    return dims.score_of(clean(col("query_type")), dims.QUERY_RISK, 0)


def weak_auth_flag() -> Column:
    return clean(col("authentication_method")).isin(dims.WEAK_AUTH).cast("int")


def suspicious_geo_flag() -> Column:
    return clean(col("geo_location")).isin(dims.SUSPICIOUS_GEO).cast("int")


def vpn_mismatch() -> Column:
    return (truthy(col("is_vpn")) != truthy(col("vpn_user"))).cast("int")


def after_hours_high_sensitivity() -> Column:
    off = clean(col("time_classification")).isin(dims.OFF_HOURS)
    return (off & (col(SENSITIVITY) >= 3)).cast("int")


def failed_action_flag() -> Column:
    return (clean(col("status")) != "success").cast("int")


# --- compounds, read from columns of the first stage -------------------------------------


def cross_dept_sensitivity() -> Column:
    return col("Cross_Dept_Access_Flag") * col(SENSITIVITY)


def time_sensitivity_risk() -> Column:
    weight = dims.score_of(clean(col("time_classification")), dims.TIME_WEIGHT, 0)
    return weight * col(SENSITIVITY)


def stale_sensitivity_risk() -> Column:
    days = F.coalesce(col("stale_account_days").cast("double"), F.lit(0.0))
    return round_to(F.log1p(days) * col(SENSITIVITY), 4)


def volume_dest_compound() -> Column:
    return round_to(F.log1p(col("Rowcount_Deviation")) * col("Exfiltration_Dest_Score"), 4)


PROFILE_STAGE = {
    "high_risk_flag": high_risk_flag,
    "notice_period_flag": notice_period_flag,
    "approved_assets": approved_assets,
}

EVENT_STAGE = {
    "Equipment_Risk_Score": equipment_risk_score,
    "Access_Tier_Mismatch": access_tier_mismatch,
    "Cross_Dept_Access_Flag": cross_dept_access_flag,
    "Rowcount_Deviation": rowcount_deviation,
    "Exfiltration_Dest_Score": exfiltration_dest_score,
    "Query_Type_Risk": query_type_risk,
    "Weak_Auth_Flag": weak_auth_flag,
    "Suspicious_Geo_Flag": suspicious_geo_flag,
    "VPN_Mismatch": vpn_mismatch,
    "After_Hours_High_Sensitivity": after_hours_high_sensitivity,
    "Failed_Action_Flag": failed_action_flag,
}

COMPOUND_STAGE = {
    "Cross_Dept_Sensitivity": cross_dept_sensitivity,
    "Time_Sensitivity_Risk": time_sensitivity_risk,
    "Stale_Sensitivity_Risk": stale_sensitivity_risk,
    "Volume_Dest_Compound": volume_dest_compound,
}
