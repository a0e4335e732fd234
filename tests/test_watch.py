"""The streamed watch list against the batch one."""

import datetime as dt

from wardline.operators.feedback import watch_list
from wardline.streaming.watch import watch_stream

T0 = dt.datetime(2024, 1, 1)
EVENT, DECISION = "access_id string, user_id string, timestamp timestamp", "user_id string, decided_at timestamp, decision string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def folder(spark, tmp_path, name, batches, schema):
    """One file for each micro-batch, read in the order of writing."""
    path = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_watch_stream(spark, tmp_path):
    users = ["u1", "u2", "u3"]
    events = [(f"e{u}{h}", u, at(h)) for h in range(0, 120, 5) for u in users]
    events += [("none", None, at(20)), ("timeless", "u1", None)]
    decisions = [
        ("u1", at(10), "Monitor"), ("u1", at(10), "Monitor"), ("u1", at(30), "Monitor"), ("u1", at(90), "Quarantine"),
        ("u2", at(50), "Monitor"), ("u2", None, "Monitor"), (None, at(20), "Monitor"),
    ]
    expected = {
        (r.access_id, r.watched_since)
        for r in watch_list(spark.createDataFrame(events, EVENT), spark.createDataFrame(decisions, DECISION)).collect()
    }
    assert ("eu110", at(10)) in expected and ("eu235", at(50)) not in expected and ("eu275", at(50)) in expected
    # out of order within the delay, a decision after the events it concerns; last rows push the watermarks
    late = [e for e in events if e[0].endswith("35")]
    first = [e for e in events if e not in late and (e[2] is None or e[2] < at(40))]
    then = [e for e in events if e not in late and e not in first]
    far = [("far", "u9", at(1000))]
    logs = folder(spark, tmp_path, "events", [first, late + then, far, [("far2", "u9", at(1001))]], EVENT)
    log = folder(
        spark, tmp_path, "decisions", [decisions[4:], decisions[:4], [("u9", at(990), "Monitor")], [("u9", at(1001), "Monitor")]],
        DECISION,
    )
    # both sides' marks stay at the start until the second batch, so nothing above is too late for a delay of 5 days
    run = (
        watch_stream(logs, log, "5 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if not r.access_id.startswith("far")]
    assert len(rows) == len({r.access_id for r in rows}) == 24 * 3 + 1  # each once, those that nobody watches too
    assert {(r.access_id, r.watched_since) for r in rows if r.watched_since} == expected
    assert all(r.watched_since is None for r in rows if r.user_id in ("u3", None))
