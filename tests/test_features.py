"""Edge rows of the features, one test per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions import text
from wardline.operators import joins
from wardline.plans import enrich as plan

REF = "2026-04-20"
AT = dt.datetime(2026, 4, 1, 10, 0, 0)

LOG = dict(
    access_id="A", timestamp=AT, user_id="U", username="u", department="IT", data_asset="Dev_DB",
    data_sensitivity="low", data_category="Technical", query_type="SELECT", rowcount=10,
    access_method="CLI", destination="internal_server", status="success", source_ip="10.0.0.1",
    bytes_transferred=1, session_duration_min=1.0, client_application="curl",
    authentication_method="MFA", is_vpn=False, geo_location="London",
    time_classification="business_hours", anomaly_marker=None,
)
PROFILE = dict(
    user_id="U", username="u", email="e", department="IT", job_title="DBA", access_tier="standard",
    tenure_months=24, approved_data_assets="Dev_DB|PROD_DB", avg_queries_per_day=5.0,
    typical_access_hours="8-18", avg_rowcount_per_query=10, high_risk_flag=False,
    equipment="company_laptop", clearance_level="internal", notice_period=False,
    last_performance_rating=4.0, security_training_current=True, failed_logins_30d=0,
    vpn_user=False, last_access_date=dt.date(2026, 4, 18),
)


def frames(spark, logs, profiles):
    lf = spark.createDataFrame([tuple({**LOG, **r}[f.name] for f in schemas.LOGS) for r in logs], schemas.LOGS)
    pf = spark.createDataFrame(
        [tuple({**PROFILE, **r}[f.name] for f in schemas.PROFILES) for r in profiles], schemas.PROFILES
    )
    return lf, pf


def features(spark, log=None, profile=None):
    lf, pf = frames(spark, [log or {}], [profile or {}])
    return plan.enrich(lf, pf, REF).head().asDict()


CASES = [
    # log, profile, expected features
    ({}, {}, {"Equipment_Risk_Score": 0, "Cross_Dept_Access_Flag": 0, "Rowcount_Deviation": 1.0, "Temporal_Velocity": 1}),
    ({"source_ip": None}, {}, {"Equipment_Risk_Score": 2}),
    ({"source_ip": "203.0.113.1"}, {"equipment": "contractor_machine"}, {"Equipment_Risk_Score": 1}),
    ({"data_sensitivity": " High "}, {"equipment": " Contractor_Machine"}, {"Equipment_Risk_Score": 2}),
    ({"data_sensitivity": "restricted"}, {"access_tier": "executive"}, {"Access_Tier_Mismatch": 2}),
    ({"data_sensitivity": "restricted"}, {"access_tier": None}, {"Access_Tier_Mismatch": 2}),
    ({"data_sensitivity": "low"}, {"access_tier": "admin"}, {"Access_Tier_Mismatch": 0}),
    ({"data_sensitivity": None, "data_asset": "X"}, {}, {"Access_Tier_Mismatch": 0, "Cross_Dept_Sensitivity": 1}),
    ({"destination": "the moon"}, {}, {"Exfiltration_Dest_Score": 0}),
    ({"destination": " USB_Drive\t"}, {}, {"Exfiltration_Dest_Score": 3}),
    ({"query_type": None}, {}, {"Query_Type_Risk": 0}),
    ({"query_type": "Bulk_Download"}, {}, {"Query_Type_Risk": 3}),
    ({"status": None}, {}, {"Failed_Action_Flag": 1}),
    ({"status": "SUCCESS "}, {}, {"Failed_Action_Flag": 0}),
    ({"data_asset": " Dev_DB "}, {"approved_data_assets": " Dev_DB| | "}, {"Cross_Dept_Access_Flag": 0, "approved_assets_count": 1}),
    ({"data_asset": "Dev"}, {}, {"Cross_Dept_Access_Flag": 1}),
    ({"data_asset": " "}, {"approved_data_assets": "| |"}, {"Cross_Dept_Access_Flag": 1, "approved_assets_count": 0}),
    ({"data_asset": None}, {"approved_data_assets": None}, {"Cross_Dept_Access_Flag": 1, "approved_assets_count": 0}),
    ({}, {"approved_data_assets": "a|a|b"}, {"approved_assets_count": 3}),
    ({"rowcount": 50}, {"avg_rowcount_per_query": 0}, {"Rowcount_Deviation": 50}),
    ({"rowcount": 50}, {"avg_rowcount_per_query": None}, {"Rowcount_Deviation": 50}),
    ({"rowcount": None}, {}, {"Rowcount_Deviation": 0, "Volume_Dest_Compound": 0}),
    ({"rowcount": 20}, {"avg_rowcount_per_query": 3}, {"Rowcount_Deviation": 6.6667}),
    ({}, {"last_access_date": dt.date(2026, 5, 1)}, {"stale_account_days": 0, "Stale_Sensitivity_Risk": 0}),
    ({}, {"last_access_date": None}, {"stale_account_days": 0}),
    ({"data_sensitivity": "high"}, {"last_access_date": dt.date(2026, 4, 10)}, {"stale_account_days": 10, "Stale_Sensitivity_Risk": 7.1937}),
    ({}, {"tenure_months": None, "high_risk_flag": True}, {"Tenure_Risk_Modifier": 1.0, "tenure_months": 0}),
    ({}, {"tenure_months": 5, "high_risk_flag": True}, {"Tenure_Risk_Modifier": 3.0}),
    ({}, {"tenure_months": 5}, {"Tenure_Risk_Modifier": 1.5}),
    ({}, {"tenure_months": 6, "high_risk_flag": True}, {"Tenure_Risk_Modifier": 2.0, "high_risk_flag": 1}),
    ({"is_vpn": None}, {"vpn_user": True}, {"VPN_Mismatch": 1}),
    ({"is_vpn": None}, {"vpn_user": None}, {"VPN_Mismatch": 0}),
    ({"authentication_method": " API_KEY"}, {}, {"Weak_Auth_Flag": 1}),
    ({"geo_location": "Tor_Exit_Node"}, {}, {"Suspicious_Geo_Flag": 1}),
    ({"time_classification": "Night", "data_sensitivity": "restricted"}, {}, {"Time_Sensitivity_Risk": 12, "After_Hours_High_Sensitivity": 1}),
    ({"time_classification": None, "data_sensitivity": "restricted"}, {}, {"Time_Sensitivity_Risk": 0, "After_Hours_High_Sensitivity": 0}),
    ({"time_classification": "early_morning", "data_sensitivity": "medium"}, {}, {"Time_Sensitivity_Risk": 2, "After_Hours_High_Sensitivity": 0}),
    ({"rowcount": 200, "destination": "print"}, {}, {"Volume_Dest_Compound": 6.089}),
]


def test_edge_rows(spark):
    """All cases in one table, one user each."""
    logs = [{**c[0], "access_id": str(i), "user_id": str(i)} for i, c in enumerate(CASES)]
    profiles = [{**c[1], "user_id": str(i)} for i, c in enumerate(CASES)]
    lf, pf = frames(spark, logs, profiles)
    got = {r["access_id"]: r for r in plan.enrich(lf, pf, REF).collect()}
    for i, (_, _, expected) in enumerate(CASES):
        for name, value in expected.items():
            assert got[str(i)][name] == pytest.approx(value), (CASES[i], name)


def test_event_without_profile(spark):
    lf, pf = frames(spark, [{"user_id": "ghost", "data_sensitivity": "high"}], [{}])
    row = plan.enrich(lf, pf, REF).head()
    assert row["Tenure_Risk_Modifier"] == 0 and row["Cross_Dept_Access_Flag"] == 1
    assert row["Access_Tier_Mismatch"] == 1 and row["Cross_Dept_Sensitivity"] == 3
    assert all(row[f] is not None for f in schemas.FEATURES)
    assert joins.orphan_events(lf, pf).count() == 1


def test_missing_column_is_reported_without_a_job(spark):
    lf, pf = frames(spark, [{}], [{}])
    with pytest.raises(ValueError, match="source_ip"):
        plan.enrich(lf.drop("source_ip"), pf, REF)


def test_missing_path_is_reported(spark, tmp_path):
    from wardline.sources.readers import read_logs

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_logs(spark, str(tmp_path / "nothing")).count()


def test_time_classes(spark):
    # 2024-01-03 is a Wednesday, 2024-01-06 a Saturday
    expected = {
        "2024-01-06 03:00": "weekend", "2024-01-07 12:00": "weekend",
        "2024-01-03 05:59": "night", "2024-01-03 06:00": "early_morning", "2024-01-03 07:59": "early_morning",
        "2024-01-03 08:00": "business_hours", "2024-01-03 17:59": "business_hours",
        "2024-01-03 18:00": "after_hours", "2024-01-03 21:59": "after_hours",
        "2024-01-03 22:00": "night", "2024-01-03 00:00": "night",
    }
    df = spark.createDataFrame([(k,) for k in expected], "t string")
    got = df.select("t", text.time_class(F.to_timestamp("t", "yyyy-MM-dd HH:mm")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == expected


def test_truthy_accepts_text_and_booleans(spark):
    df = spark.createDataFrame([("True",), ("true",), ("False",), ("yes",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(text.truthy(F.col("v"))).collect()] == [1, 1, 0, 0, 0, 0]


def test_first_per_key_and_duplicates(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 5, "x"), (1, 2, "a")], "k int, o int, v string")
    assert {tuple(r) for r in joins.first_per_key(df, ["k"], ["o"]).collect()} == {(1, 2, "a"), (2, 5, "x")}
    assert [tuple(r) for r in joins.duplicate_keys(df, ["k"]).collect()] == [(1, 3)]


def test_salted_join_equals_plain_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i * 1.0) for i in range(300)], "id int, k string, v double")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    plain = rows.join(stats, "k")
    salted = joins.join_statistics(rows, stats, ["k"], "n", ["id"], rows_per_salt=30)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_training_keeps_one_profile_per_user(spark):
    from wardline.plans.train import train

    lf, pf = frames(spark, [{"access_id": str(i)} for i in range(5)], [{}, {"tenure_months": 3}])
    assert train(lf, pf, REF, trees=2).enriched.count() == 5


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_stays_in_the_jvm_with_one_shuffle(spark, small):
    from wardline.catalog.registry import Inputs

    shown = plan_text(Inputs(spark, small).enriched)
    assert "Python" not in shown and "ArrowEval" not in shown
    assert shown.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_scan_reads_only_needed_columns(spark, small):
    from wardline.catalog.registry import Inputs

    shown = plan_text(Inputs(spark, small).featured.select("access_id", "Weak_Auth_Flag"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,props:string>" in shown
