"""Access-audit views over the generic test tables ``events`` and ``customer``.

The same mapping is written as DuckDB SQL in ``wardline.catalog.prelude``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions.text import time_class

REFERENCE_DATE = "2024-01-31"

QUERY_TYPES = {"view": "SELECT", "click": "UPDATE", "signup": "INSERT", "purchase": "EXPORT", "error": "BULK_DOWNLOAD"}
DESTINATIONS = [
    "usb_drive", "external_email", "cloud_storage", "print", "shared_drive",
    "personal_device", "internal_server", "internal_report", "local_workstation",
]
AUTH = ["MFA", "SSO", "Password_Only", "API_Key", "Certificate", "Biometric"]
SENSITIVITY = ["low", "medium", "high", "restricted"]
CATEGORIES = ["Money", "Engineering", "People", "Personal", "Contracts", "Operations"]
PLACES = [
    "Lisbon", "Oslo", "Porto", "Turin", "Graz", "Cork", "Lyon", "Bern",
    "Unknown_VPN", "Tor_Exit_Node", "Lagos", "Pyongyang", "Caracas",
]
METHODS = ["console", "report", "service", "browser", "file_share", "shell"]
APPS = ["SSMS", "Tableau", "Power_BI", "Excel", "curl"]
TIERS = ["junior", "contractor", "standard", "senior", "admin", "executive"]
TITLES = ["Analyst", "Senior Analyst", "Developer", "Sales Manager", "VP Finance", "Paralegal"]
CLEARANCES = ["public", "internal", "confidential", "restricted"]


def pick(values: list[str], index: Column) -> Column:
    """``values[index]``, null beyond the end."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def logs_from(events: DataFrame, customers: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    who = customers.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("department"),
    )
    ident, k = F.col("event_id"), F.col("k")
    kinds = F.create_map(*[F.lit(x) for pair in QUERY_TYPES.items() for x in pair])
    rows = F.floor(F.col("value") * k).cast("long")
    failed = F.col("event_type") == "error"
    mapped = e.select(
        ident.alias("access_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "user_id",
        F.concat(F.lit("ASSET_"), (ident % 10).cast("string")).alias("data_asset"),
        pick(SENSITIVITY, (ident % 10) % 4).alias("data_sensitivity"),
        pick(CATEGORIES, ident % 6).alias("data_category"),
        F.try_element_at(kinds, F.col("event_type")).alias("query_type"),
        rows.alias("rowcount"),
        pick(METHODS, ident % 6).alias("access_method"),
        pick(DESTINATIONS, k % 9).alias("destination"),
        F.when(failed, "failure").otherwise("success").alias("status"),
        F.concat(F.when(k % 8 == 0, "203.0.113.").otherwise("10.0.0."), k.cast("string")).alias("source_ip"),
        (rows * (80 + ident % 421)).alias("bytes_transferred"),
        F.round((ident % 1200) / 10 + 0.1, 1).alias("session_duration_min"),
        pick(APPS, ident % 5).alias("client_application"),
        pick(AUTH, k % 6).alias("authentication_method"),
        (ident % 3 == 0).alias("is_vpn"),
        pick(PLACES, ident % 13).alias("geo_location"),
        time_class(F.col("ts")).alias("time_classification"),
        F.when(failed & (k % 5 == 0), "FAILED_AUTH_BURST").alias("anomaly_marker"),
    )
    return mapped.join(who, "user_id", "left")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(load(spark, sf_dir, "events"), load(spark, sf_dir, "customer"))


def spread_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, dealt to all tasks before any column is derived.

    A row group of a file is read by one task, which would also derive every column of its rows.
    """
    events = load(spark, sf_dir, "events")
    return logs_from(events.repartition("event_id", "user_id", "ts"), load(spark, sf_dir, "customer"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    asset = lambda n: F.concat(F.lit("ASSET_"), ((key + n) % 10).cast("string"))
    return load(spark, sf_dir, "customer").where(key % 20 != 7).select(
        key.alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("department"),
        pick(TITLES, key % 6).alias("job_title"),
        pick(TIERS, key % 7).alias("access_tier"),
        (key % 60).cast("int").alias("tenure_months"),
        F.concat(asset(0), F.lit("| "), asset(3), F.lit("|"), asset(7)).alias("approved_data_assets"),
        (5 + key % 20).cast("double").alias("avg_queries_per_day"),
        F.concat((6 + key % 4).cast("string"), F.lit("-"), (17 + key % 6).cast("string")).alias("typical_access_hours"),
        ((key % 40) * 25).cast("int").alias("avg_rowcount_per_query"),
        (F.col("c_acctbal") < 0).alias("high_risk_flag"),
        F.when(key % 8 == 0, "contractor_machine").otherwise("company_laptop").alias("equipment"),
        pick(CLEARANCES, key % 4).alias("clearance_level"),
        (key % 12 == 0).alias("notice_period"),
        (1 + (key % 9) / 2).cast("double").alias("last_performance_rating"),
        (key % 10 != 0).alias("security_training_current"),
        (key % 25).cast("int").alias("failed_logins_30d"),
        (key % 3 == 0).alias("vpn_user"),
        F.date_sub(F.lit(REFERENCE_DATE).cast("date"), (key % 180).cast("int")).alias("last_access_date"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset catalogue with an entry for each part."""
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("ASSET_"), F.col("p_partkey").cast("string")).alias("data_asset"),
        pick(SENSITIVITY, F.col("p_size") % 4).alias("sensitivity"),
        F.col("p_type").alias("category"),
    )


def user_labels(profiles: DataFrame) -> DataFrame:
    """A label for each user, by the profile's risk flag."""
    risky = F.col("high_risk_flag")
    return profiles.select(
        "user_id",
        risky.alias("is_anomaly"),
        F.when(risky, "FLAGGED").otherwise("NORMAL").alias("risk_type"),
        F.when(risky, "HIGH").otherwise("NONE").alias("severity"),
        F.lit(None).cast("string").alias("explanation"),
    )


def assets_of(logs: DataFrame) -> DataFrame:
    """The asset catalogue that the logs themselves imply."""
    named = logs.select("data_asset", F.col("data_sensitivity").alias("sensitivity"))
    return named.distinct()
