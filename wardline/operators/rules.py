"""Declarative rules, typed anomaly rules, user-risk reasons and labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline import dims
from wardline.functions.features import is_high_sensitivity
from wardline.functions.text import clean, hours_range, pipe_list
from wardline.operators.windows import last_before
from wardline.session import materialize


# --- declarative rules -------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A condition in SQL over the event's columns, and what follows from it."""

    rule_id: str
    condition: str
    severity: str
    actions: str


DEFAULT_RULES = [
    Rule(
        "off_hours_restricted",
        "hour(timestamp) NOT BETWEEN 8 AND 18 AND lower(trim(data_sensitivity)) = 'restricted'",
        "HIGH",
        "alert,block",
    ),
    Rule("bulk_rows", "rowcount > 5000", "MEDIUM", "alert"),
    Rule(
        "external_export",
        "lower(trim(query_type)) IN ('export', 'bulk_download') AND lower(trim(destination)) IN "
        "('external_email', 'usb_drive', 'cloud_storage', 'personal_device')",
        "CRITICAL",
        "alert,block",
    ),
    Rule("failed_from_outside", "status <> 'success' AND source_ip NOT LIKE '10.%'", "MEDIUM", "alert"),
]


def rule_hits(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (event, matched rule). All rules are tested in a single pass."""
    tests = [
        F.when(
            F.expr(r.condition),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.severity).alias("rule_severity"),
                F.split(F.lit(r.actions), ",").alias("rule_actions"),
            ),
        )
        for r in rules
    ]
    return events.select("*", F.inline(F.array_compact(F.array(*tests))))


def without_exceptions(hits: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Drop hits that an approved exception (rule_id, department, weekday) covers."""
    weekday = F.weekday("timestamp")
    hit, exc = hits.withColumn("_weekday", weekday).alias("h"), exceptions.alias("x")
    covered = (
        (F.col("h.rule_id") == F.col("x.rule_id"))
        & (F.col("h.department") == F.col("x.department"))
        & (F.col("h._weekday") == F.col("x.weekday"))
    )
    return hit.join(exc, covered, "left_anti").drop("_weekday")


def disjoint_periods(context: DataFrame) -> DataFrame:
    """Periods (user_id, starts, ends) with those of a user that overlap or touch made one."""
    order = Window.partitionBy("user_id").orderBy("starts", "ends")
    before = F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("starts") > before + F.expr("INTERVAL 1 MICROSECOND"))).cast("int")
    numbered = context.where("starts <= ends").withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return numbered.groupBy("user_id", "_island").agg(F.min("starts").alias("starts"), F.max("ends").alias("ends")).drop("_island")


def outside_context(hits: DataFrame, context: DataFrame) -> DataFrame:
    """Drop hits of a user during a known period (user_id, starts, ends): leave, on-call, new role.

    Periods are made disjoint first. A hit lies in one if the user's latest start up to it is later than the latest
    end before it; both come from one pass each over hits and borders in order, so no hit meets more than that.
    """
    at = lambda c: F.col(c).cast("timestamp")
    periods = materialize(disjoint_periods(context.select("user_id", at("starts").alias("starts"), at("ends").alias("ends"))), "periods")
    starts = periods.select("user_id", F.col("starts").alias("timestamp"))
    after = periods.select("user_id", (F.col("ends") + F.expr("INTERVAL 1 MICROSECOND")).alias("timestamp"))
    marked = last_before(last_before(hits, starts, "user_id", "timestamp", "_began"), after, "user_id", "timestamp", "_ended")
    inside = F.col("_began").isNotNull() & (F.col("_ended").isNull() | (F.col("_ended") < F.col("_began")))
    # a hit without user or time is in no period
    known = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()
    return marked.where(~(inside & known)).drop("_began", "_ended")


# --- typed anomaly rules -----------------------------------------------------------------


def anomaly_predicates() -> dict[str, Column]:
    """One predicate per anomaly type over an event joined with its profile and features.

    Needs the log columns, ``notice_period_flag``, ``access_tier`` and the event features.
    """
    hour = F.hour("timestamp")
    exporting = clean(F.col("query_type")).isin(dims.EXPORT_QUERIES)
    bulk_kind = clean(F.col("query_type")).isin(*dims.EXPORT_QUERIES, "select")
    dest = clean(F.col("destination"))
    tier = clean(F.col("access_tier"))
    sensitive = is_high_sensitivity()
    volume = F.col("Rowcount_Deviation")
    return {
        "NIGHT_BULK_CRITICAL": (hour < 5)
        & exporting
        & dest.isin("external_email", "usb_drive", "cloud_storage")
        & (volume >= 20)
        & sensitive,
        "EXFILTRATION_RISK": exporting & dest.isin(dims.RISKY_DESTINATIONS) & sensitive & (volume >= 3),
        "PRE_RESIGNATION_DOWNLOAD": (F.col("notice_period_flag") == 1)
        & bulk_kind
        & dest.isin(dims.EXTERNAL_DESTINATIONS)
        & (volume >= 5),
        "BULK_EXPORT": bulk_kind & sensitive & (volume >= 10),
        "AFTER_HOURS_RESTRICTED": ((hour >= 22) | (hour < 6)) & sensitive,
        "STALE_ACCOUNT_ACCESS": F.col("stale_account_days") > 150,
        "PRIVILEGE_ESCALATION": tier.isin("junior", "standard") & (F.col("Access_Tier_Mismatch") >= 2),
        "CROSS_DEPT_ACCESS": (F.col("Cross_Dept_Access_Flag") == 1)
        & sensitive
        & (F.col("Query_Type_Risk") >= 3),
        "DEVICE_ANOMALY": (F.col("Equipment_Risk_Score") == 2) & (F.col("VPN_Mismatch") == 1),
        "FAILED_AUTH_BURST": (F.col("Failed_Action_Flag") == 1) & (F.col("Temporal_Velocity") >= 2),
    }


def typed_anomalies(events: DataFrame) -> DataFrame:
    """Labels by rule: the first matching type in severity order, else NORMAL; plus all matches."""
    tests = anomaly_predicates()
    order = list(dims.ANOMALY_SEVERITY)
    first = reduce(lambda acc, t: acc.when(tests[t], t), order, F).otherwise("NORMAL")
    every = F.array_compact(F.array(*[F.when(tests[t], F.lit(t)) for t in order]))
    typed = events.withColumns({"anomaly_type": first, "matched_types": every})
    rank = reduce(
        lambda acc, t: acc.when(F.col("anomaly_type") == t, dims.ANOMALY_SEVERITY[t]), order, F
    )
    return typed.withColumns(
        {
            "is_anomaly": F.col("anomaly_type") != "NORMAL",
            "severity": rank.otherwise("NONE"),
            "explanation": F.when(F.col("anomaly_type") == "NORMAL", "No rule matched.").otherwise(
                F.concat(F.lit("Matches the rule "), F.col("anomaly_type"), F.lit("."))
            ),
        }
    )


def naive_night(events: DataFrame) -> DataFrame:
    """The comparator that flags every access at night."""
    hour = F.hour("timestamp")
    flagged = (hour >= 22) | (hour < 6)
    return events.select("access_id", F.when(flagged, -1).otherwise(1).alias("prediction"))


def outside_typical_hours() -> Column:
    """1 when the hour lies outside the user's own "lo-hi" hours; unknown hours give 0."""
    lo, hi = hours_range(F.col("typical_access_hours"))
    inside = F.hour("timestamp").between(lo, F.least(hi, F.lit(23)))
    return F.when(inside, 0).when(~inside, 1).otherwise(0)


# --- user risk ---------------------------------------------------------------------------


def risk_reasons(profiles: DataFrame, assets: DataFrame) -> DataFrame:
    """Add ``reasons``: notice, low rating, failed logins, contractor with a sensitive asset.

    Only contractors' lists are expanded for the look-up of asset sensitivities.
    """
    contractor = clean(F.col("access_tier")) == "contractor"
    sensitive = assets.where(clean(F.col("sensitivity")).isin(dims.HIGH_SENSITIVITY))
    reach = (
        profiles.where(contractor)
        .select("user_id", F.explode(pipe_list(F.col("approved_data_assets"))).alias("data_asset"))
        .join(sensitive.select("data_asset").distinct(), "data_asset", "left_semi")
        .select("user_id")
        .distinct()
        .withColumn("_reach", F.lit(True))
    )
    reasons = F.array(
        F.when(F.col("notice_period"), F.lit("resignation_filed")),
        F.when(F.col("last_performance_rating") <= 2.0, F.lit("low_performance_pip")),
        F.when(F.col("failed_logins_30d") >= 10, F.lit("account_compromise_risk")),
        F.when(F.col("_reach"), F.lit("contractor_sensitive_access")),
    )
    joined = profiles.join(reach, "user_id", "left")
    return joined.withColumn("reasons", F.array_compact(reasons)).drop("_reach")


def user_risk_labels(with_reasons: DataFrame) -> DataFrame:
    """(user_id, is_anomaly, risk_type, severity, explanation) by the first reason that applies."""
    has = lambda r: F.array_contains("reasons", r)
    n_assets = F.size(pipe_list(F.col("approved_data_assets"))).cast("string")
    cases = [
        (
            has("resignation_filed"), "NOTICE_PERIOD_RISK", "HIGH",
            F.concat(F.lit("On notice, may use "), n_assets, F.lit(" assets.")),
        ),
        (
            has("account_compromise_risk"), "STALE_ACCOUNT", "HIGH",
            F.concat(F.col("failed_logins_30d").cast("string"), F.lit(" failed logins in 30 days.")),
        ),
        (
            has("contractor_sensitive_access"), "OVER_PRIVILEGED", "MEDIUM",
            F.lit("Contractor approved for sensitive assets."),
        ),
        (
            has("low_performance_pip"), "NOTICE_PERIOD_RISK", "MEDIUM",
            F.concat(F.lit("Rated "), F.format_string("%.1f", "last_performance_rating"), F.lit(".")),
        ),
        (
            F.coalesce(F.col("high_risk_flag"), F.lit(False)), "EXCESSIVE_SYSTEMS", "MEDIUM",
            F.lit("Marked as a risk without a listed reason."),
        ),
    ]
    pick = lambda i, default: reduce(
        lambda acc, c: acc.when(c[0], c[i]), cases, F
    ).otherwise(default)
    risk = pick(1, "NORMAL")
    return with_reasons.select(
        "user_id",
        (risk != "NORMAL").alias("is_anomaly"),
        risk.alias("risk_type"),
        pick(2, "NONE").alias("severity"),
        pick(3, F.lit("Nothing out of the ordinary.")).alias("explanation"),
    )
