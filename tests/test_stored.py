"""The stored feature table: dealt to all tasks, its labels and request hashes made once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.catalog.registry import REGISTRY, Inputs
from wardline.operators import windows
from wardline.schemas import FEATURES, IDS
from wardline.sources import sample_views as views


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of one row group, some without time, user, value or properties, with ids that repeat or are null."""
    at = str(tmp_path_factory.mktemp("odd"))
    kinds = ["view", "click", "signup", "purchase", "error"]
    start = datetime(2024, 1, 5)
    rows = [
        (
            i if i % 50 else None,
            None if i % 41 == 3 else start + timedelta(minutes=7 * i),
            None if i % 37 == 5 else i % 23,
            kinds[i % 5],
            None if i % 31 == 7 else float(i % 90),
            None if i % 29 == 1 else '{"k": %d}' % (i % 100),
        )
        for i in range(600)
    ]
    rows += rows[100:103]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/events.parquet")
    people = [(i, f"Customer#{i}", "MACHINERY" if i % 2 else None, -5.0 if i % 3 else None) for i in range(20)]
    customers = spark.createDataFrame(people, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    customers.write.parquet(f"{at}/customer.parquet")
    return at


def rows_of(df):
    return sorted(map(repr, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_group_is_dealt_before_columns_are_derived(spark, folder):
    q = Inputs(spark, folder)
    used = lambda df: df.select(F.spark_partition_id()).distinct().count()
    merging = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert used(views.logs(spark, folder)) == 1 < used(q.spread_logs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merging)
    assert rows_of(q.spread_logs) == rows_of(q.logs)
    assert q.stored.columns == [*IDS, *FEATURES]
    assert rows_of(q.stored) == rows_of(q.enriched)


def test_cells_are_counted_only_if_a_key_is_large(spark, monkeypatch):
    asked = []
    more = windows._has_more
    monkeypatch.setattr(windows, "_has_more", lambda rows, limit: asked.append(rows.columns) or more(rows, limit))
    df = spark.createDataFrame([(i, i % 3, datetime(2024, 1, 1, i)) for i in range(12)], "id int, u int, t timestamp")
    count = lambda limit: rows_of(windows.trailing_count(df, df, "u", "t", "id", "n", dense_cell_rows=limit))
    want = count(4)
    assert asked == [["u"]]
    assert count(3) == want and asked[1:] == [["u"], ["u", "_c"]]  # 4 events a key, 1 a cell
    assert count(0) == want and len(asked) == 5


def test_labels_come_from_the_stored_table(spark, folder):
    q = Inputs(spark, folder)
    assert rows_of(q.stored_labels) == rows_of(q.labels)
    assert "Window" not in plan_of(REGISTRY["m5_model_metrics"].run(q))


def test_alert_labels_come_from_the_stored_table(spark, folder):
    assert "Window" not in plan_of(REGISTRY["t1_alerts"].run(Inputs(spark, folder)))


def test_requests_are_hashed_once(spark, folder):
    q = Inputs(spark, folder)
    answers = REGISTRY["t6_response"].run(q)
    assert "sha2(" not in plan_of(answers)
    assert answers.count() > 0 and {r.reused for r in answers.collect()} <= {False, True}
