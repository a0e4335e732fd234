"""Streams in several micro-batches must equal the batch job."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row, functions as F

from wardline.catalog.registry import Inputs
from wardline.plans.enrich import enrich
from wardline.schemas import FEATURES, IDS
from wardline.sources import sample_views as views
from wardline.operators.windows import trailing_count
from wardline.streaming import ingest, jobs, trailing


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The logs as files in time order, each read as its own micro-batch."""
    folder = str(tmp_path_factory.mktemp("parts"))
    logs = Inputs(spark, small).logs
    for i in range(4):
        logs.where(f"access_id BETWEEN {i * 250} AND {i * 250 + 249}").coalesce(1).write.mode("append").parquet(folder)
    return folder, logs


def log_stream(spark, parts):
    folder, logs = parts
    return ingest.log_files(spark, folder, logs.schema, maxFilesPerTrigger=1)


def test_stream_equals_batch(spark, small, parts, tmp_path):
    profiles = views.profiles(spark, small)
    run = jobs.score_stream(
        log_stream(spark, parts), profiles, views.REFERENCE_DATE, str(tmp_path / "out"), str(tmp_path / "cp"),
        available_now=True,
    )
    run.awaitTermination()
    stored = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert stored.select("batch_id").distinct().count() == 4
    columns = [*IDS, *FEATURES]
    batch = enrich(parts[1], profiles, views.REFERENCE_DATE).select(columns)
    assert stored.count() == batch.count() == 1000
    assert batch.exceptAll(stored.select(columns)).count() == 0


def test_batches_without_times_are_kept(spark, small, parts, tmp_path):
    """A micro-batch whose rows all lack a time is written like any other."""
    folder, logs = str(tmp_path / "in"), parts[1]
    for i, rows in enumerate([logs.where("access_id < 20"), logs.where("access_id BETWEEN 20 AND 24").withColumn("timestamp", F.lit(None).cast("timestamp")), logs.where("access_id BETWEEN 25 AND 40")]):
        rows.coalesce(1).write.mode("append").parquet(folder)
    profiles = views.profiles(spark, small)
    stream = ingest.log_files(spark, folder, logs.schema, maxFilesPerTrigger=1)
    out = str(tmp_path / "out")
    jobs.score_stream(stream, profiles, views.REFERENCE_DATE, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    stored = spark.read.option("basePath", out).parquet(out).select(*IDS, *FEATURES)
    batch = enrich(spark.read.parquet(folder), profiles, views.REFERENCE_DATE).select(*IDS, *FEATURES)
    assert stored.count() == 41 and batch.exceptAll(stored).count() == 0


def test_repeats_within_an_hour_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "access_id int, user_id string, timestamp timestamp"
    start = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate([0, 30, 300]):
        row = [(i, "u", start + dt.timedelta(minutes=minutes))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.log_files(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger=1)
    out = jobs.run_to_table(jobs.without_repeats(stream, ["user_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["access_id"] for r in out.collect()) == [0, 2]


def test_rates_equal_batch_for_closed_windows(spark, parts, tmp_path):
    stream = log_stream(spark, parts).select("timestamp", "status")
    out = jobs.run_to_table(
        jobs.event_rates(stream, ["status"], "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    whole = parts[1].groupBy(F.window("timestamp", "1 hour").alias("w"), "status").count()
    whole = whole.select(F.col("w.start"), F.col("w.end"), "status", "count")
    closed = out.count()
    assert 0 < closed <= whole.count()
    assert out.exceptAll(whole).count() == 0


def test_partial_json_events_get_defaults(spark):
    df = spark.createDataFrame(
        [('{"access_id": "1", "timestamp": "2024-01-06T03:00:00.000Z"}',), ("not json",)], "value string"
    )
    first, second = ingest.parse_events(df, "value").collect()
    assert (first["query_type"], first["status"], first["time_classification"]) == ("SELECT", "success", "weekend")
    assert second["access_id"] is None and second["rowcount"] == 0


def test_a_second_run_adds_nothing(spark, parts, tmp_path):
    """Without new data the mark is the one before: no window or session comes twice."""
    logs = parts[1]
    slim, paths = ["timestamp", "status", "user_id"], lambda x: (str(tmp_path / x), str(tmp_path / f"{x}_cp"))
    for _ in range(2):
        rates = jobs.whole_rates(log_stream(spark, parts).select(slim), logs, ["status"], *paths("rates"))
        sessions = jobs.whole_sessions(log_stream(spark, parts).select(slim), logs, *paths("sessions"))
        for got, want in ((rates, jobs.event_rates(logs, ["status"])), (sessions, jobs.session_stream(logs))):
            assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_repeated_profiles_are_refused(spark, small, parts, tmp_path):
    profiles = views.profiles(spark, small)
    for start in (jobs.score_stream, jobs.score_stream_revised):
        with pytest.raises(ValueError, match="profiles"):
            start(log_stream(spark, parts), profiles.unionByName(profiles), views.REFERENCE_DATE, str(tmp_path / "o"), str(tmp_path / "c"))


def run_revised(spark, batches, tmp_path, delay):
    """Batches of (id, user, time) as micro-batches; all versions and the last progress."""
    folder, schema = str(tmp_path / "in"), "access_id long, user_id string, timestamp timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.log_files(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger=1)
    counted = trailing.trailing_stream(stream, "user_id", "timestamp", "access_id", "n", delay)
    out = str(tmp_path / "out")
    run = trailing.versions(counted, "timestamp", out, str(tmp_path / "cp"), available_now=True)
    run.awaitTermination()
    return spark.read.option("basePath", out).parquet(out), trailing.current(spark, out, "access_id"), run


def test_late_events_revise(spark, tmp_path):
    """Any order of arrival, repeated instants, null users and times: the latest versions are the batch result."""
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "b", None]), start + dt.timedelta(minutes=10 * rnd.randrange(60))) for i in range(240)]
    rows += [(900 + i, "a", None) for i in range(4)]
    rnd.shuffle(rows)
    every, latest, _ = run_revised(spark, [rows[:80], rows[80:160], rows[160:]], tmp_path, "30 days")
    logs = spark.createDataFrame(rows, "access_id long, user_id string, timestamp timestamp")
    want = trailing_count(logs, logs.select("user_id", "timestamp"), "user_id", "timestamp", "access_id", "n")
    order = ["access_id", "user_id", "timestamp", "n"]
    assert latest.count() == 244 and latest.select(order).exceptAll(want.select(order)).count() == 0
    assert every.count() > 244


def test_one_call_of_the_state_serves_many_users():
    """Users of a bucket, null among them, are counted apart; a later call returns only what it changes."""
    held = []

    class Held:
        def get(self):
            return iter(list(held))

        def appendList(self, rows):
            held.extend(rows)

    class Handle:
        def getListState(self, name, schema):
            return Held()

        def registerTimer(self, at):
            pass

    span = 3600 * trailing.SECOND
    hour = trailing.TrailingHour("", ["id", "user"], "user", "n", span)
    hour.init(Handle())
    rnd = random.Random(4)
    made = Row("micros_", "tie_", "own_", "id", "user")
    rows = []
    for i in range(400):  # of the hour 0, which counts, and of the hour before it
        t = rnd.randrange(-60, 60) * 60 * trailing.SECOND
        rows.append(made(t, i, t >= 0, i, rnd.choice([1, 2, 3, None])))
    late = next(r for r in rows if r.user == 2 and r.own_)
    rest = [r for r in rows if r is not late and not (r.user == 1 and r.micros_ > 0)]
    latest = {r.id: r.n for r in hour.handleInputRows((0, 0), iter(rest), None)}
    revised = {r.id: r.n for r in hour.handleInputRows((0, 0), iter([late]), None)}
    by_id = {r.id: r for r in rows}
    assert late.id in revised and {by_id[i].user for i in revised} == {2}
    latest |= revised
    seen = [*rest, late]
    place = lambda r: (r.micros_, r.tie_)
    want = {
        r.id: sum(o.user == r.user and r.micros_ - span < o.micros_ and place(o) <= place(r) for o in seen)
        for r in seen if r.own_
    }
    assert latest == want


def test_state_falls_after_the_hour(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    batches = [[(10 * k + i, "u", start + dt.timedelta(hours=3 * k, minutes=i)) for i in range(5)] for k in range(4)]
    batches.append([(99, "u", start)])  # later than the delay: dropped
    _, latest, run = run_revised(spark, batches, tmp_path, "10 minutes")
    assert sorted((r.access_id, r.n) for r in latest.collect()) == [(10 * k + i, i + 1) for k in range(4) for i in range(5)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) for x in run.recentProgress) if p["stateOperators"]]
    assert max(held) <= 3 * min(h for h in held if h)


def test_open_windows_after_several_batches(spark, parts, tmp_path):
    folder, logs = parts
    slim, paths = ["timestamp", "status", "user_id"], lambda x: (str(tmp_path / x), str(tmp_path / f"{x}_cp"))
    rates = jobs.whole_rates(log_stream(spark, parts).select(slim), logs, ["status"], *paths("rates"))
    sessions = jobs.whole_sessions(log_stream(spark, parts).select(slim), logs, *paths("sessions"))
    for got, want in ((rates, jobs.event_rates(logs, ["status"])), (sessions, jobs.session_stream(logs))):
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
