"""Scores, responses, rules, evaluation and feedback on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline.functions import responses, scoring
from wardline.operators import baselines, evaluate, feedback, joins, rules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "raw, score, band, action",
    [
        (-0.9, 100, "critical", "Quarantine"), (-0.5, 100, "critical", "Quarantine"),
        (-0.3, 80, "critical", "Investigate"), (-0.1, 60, "high", "Monitor"),
        (0.0, 50, "elevated", "Monitor"), (0.1, 40, "elevated", "Monitor"),
        (0.5, 0, "low", "Monitor"), (3.0, 0, "low", "Monitor"), (0.375, 12, "low", "Monitor"),
    ],
)
def test_scores(spark, raw, score, band, action):
    s = scoring.risk_score(F.lit(raw))
    row = spark.range(1).select(s, scoring.risk_band(s), scoring.recommended_action(F.lit(raw))).head()
    assert tuple(row) == (score, band, action)


def test_display(spark):
    assert one(spark, scoring.display_user(F.lit("kavya.dubois"))) == "Kavya Dubois"
    assert one(spark, scoring.display_user(F.lit("USR.42"))) == "USR.42"
    assert one(spark, scoring.display_type(F.lit("BULK_EXPORT"))) == "Bulk Export"
    assert one(spark, scoring.display_time(F.lit("2025-10-10 00:08:23"))) == "10 Oct 2025 at 00:08"
    assert one(spark, scoring.display_time(F.lit("soon"))) == "soon"
    assert one(spark, scoring.bar_widths(F.array(F.lit(-2.0), F.lit(1.0)))) == [100.0, 50.0]
    assert one(spark, scoring.bar_widths(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


ANSWERS = [
    ('{"threat_narrative": "x", "evidence_list": ["a"], "recommended_action": "Quarantine"}', True, "Quarantine"),
    ('```json\n{"recommended_action": "Investigate"}\n```', True, "Investigate"),
    ('```\n{"recommended_action": "Panic"}\n```', True, "Monitor"),
    ('Well: {"recommended_action": "Quarantine", "more": {"k": 1}} so there', True, "Quarantine"),
    ("[1, 2]", False, "Monitor"),
    ("17", False, "Monitor"),
    ("no object { here", False, "Monitor"),
    ("", False, "Monitor"),
    ("{" * 20000 + "x", False, "Monitor"),
    ("{" + "{a}" * 20000, False, "Monitor"),
]


def test_json_salvage(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, answer string")
    got = responses.salvage(df.withColumn("raw", F.lit(0.2)), "answer", "raw").orderBy("i").collect()
    for row, (text, is_json, action) in zip(got, ANSWERS):
        assert (row["is_json"], row["recommended_action"]) == (is_json, action), text[:60]
    assert got[0]["evidence_list"] == ["a"] and got[1]["evidence_list"] == []


def test_metrics_without_predicted_positives(spark):
    df = spark.createDataFrame([(False, True), (False, False)], "predicted boolean, actual boolean")
    row = evaluate.metrics(df).head()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["Normal"]["recall"] == 1.0 and report["Anomaly"]["support"] == 1


def test_metrics_join_by_id_not_by_position(spark):
    pred = spark.createDataFrame([("b", -1), ("a", 1)], "access_id string, prediction int")
    lab = spark.createDataFrame(
        [("a", False, "NORMAL", "NONE"), ("b", True, "BULK_EXPORT", "HIGH")],
        "access_id string, is_anomaly boolean, anomaly_type string, severity string",
    )
    assert evaluate.metrics(evaluate.labelled(pred, lab)).head()["f1_score"] == 1.0


def test_rules_and_exceptions(spark):
    logs = spark.createDataFrame(
        [
            (1, "u", "Finance", dt.datetime(2024, 1, 5, 12), 9000),  # a Friday
            (2, "u", "Finance", dt.datetime(2024, 1, 4, 12), 9000),
            (3, "u", "IT", dt.datetime(2024, 1, 5, 12), 10),
        ],
        "access_id int, user_id string, department string, timestamp timestamp, rowcount long",
    )
    hits = rules.rule_hits(logs, [rules.Rule("bulk", "rowcount > 5000", "MEDIUM", "alert")])
    assert sorted(r["access_id"] for r in hits.collect()) == [1, 2]
    fridays = spark.createDataFrame([("bulk", "Finance", 4)], "rule_id string, department string, weekday int")
    assert [r["access_id"] for r in rules.without_exceptions(hits, fridays).collect()] == [2]


def test_decision_log_is_append_only(spark, tmp_path):
    path = str(tmp_path / "decisions")
    schema = "access_id string, user_id string, decided_at timestamp, decision string, analyst string"
    for i, kind in enumerate(["Monitor", "False Positive"]):
        row = (str(i), "u", dt.datetime(2024, 1, 1 + i), kind, "x")
        feedback.record_decisions(spark.createDataFrame([row], schema), path)
    assert spark.read.parquet(path).count() == 2
    bad = spark.createDataFrame([("9", "u", dt.datetime(2024, 1, 3), "Shrug", "x")], schema)
    with pytest.raises(Exception, match="unknown decision"):
        feedback.record_decisions(bad, path)


def test_calendar_phase(spark):
    days = {"2024-03-29": "quarter_end", "2024-01-29": "month_end", "2024-01-28": "ordinary", "2024-12-31": "quarter_end"}
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = df.select("d", baselines.calendar_phase(F.to_date("d")).alias("p")).collect()
    assert {r["d"]: r["p"] for r in got} == days


def test_no_score_no_risk(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.6,), (-0.6,)], "raw double")
    risk = scoring.risk_score(F.col("raw"))
    got = df.select(risk, scoring.risk_band(risk), scoring.recommended_action(F.col("raw"))).collect()
    assert [tuple(r) for r in got] == [(None,) * 3, (None,) * 3, (0, "low", "Monitor"), (100, "critical", "Quarantine")]


def test_repeated_labels_and_logs_keep_one_alert(spark):
    alerts = spark.createDataFrame([(1,), (2,)], "access_id long")
    labels = spark.createDataFrame(
        [(1, True, "B", "HIGH", "x"), (1, True, "A", "HIGH", "x"), (1, True, "A", "HIGH", "x")],
        "access_id long, is_anomaly boolean, anomaly_type string, severity string, explanation string",
    )
    got = joins.with_labels(alerts, labels).orderBy("access_id").collect()
    assert [(r.access_id, r.anomaly_type) for r in got] == [(1, "A"), (2, "UNKNOWN")]
    logs = spark.createDataFrame([(1, *"abcdef"), (1, *"abcdeg")], ", ".join(["access_id long"] + [f"{c} string" for c in joins.CONTEXT]))
    got = joins.with_context(alerts, logs).orderBy("access_id").collect()
    assert [(r.access_id, r.destination) for r in got] == [(1, "f"), (2, "unknown")]


def test_nested_object_in_text(spark):
    texts = [
        'Here: {"recommended_action":"Quarantine","x":{"y":{"recommended_action":"Monitor"}}} end }',
        'a "brace {" in quotes: {"t":"} \\" {","n":{"m":1}} {"second":2}',
        "never {closed {a}", "none", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(responses.embedded_object(F.col("t"))).collect()]
    assert got[0] == texts[0][6:-6]
    assert got[2:5] == ["", "", ""] and not got[5]
    answer = responses.salvage(df.withColumn("raw", F.lit(0.2)).where("i = 0"), "t", "raw").first()
    assert answer.is_json and answer.recommended_action == "Quarantine"
