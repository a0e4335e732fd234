"""Trailing counts, sequencing, look-back and sessions against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small test tables would be merged into one range, and no border would be tested."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, u string, t timestamp, v string")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def trailing(df, **kw):
    out = windows.trailing_count(df, df.select("u", "t"), "u", "t", "id", "n", **kw)
    return {r["id"]: r["n"] for r in out.collect()}


def expected_trailing(rows, seconds=3600):
    out = {}
    for i, u, t, _ in rows:
        if t is None:
            out[i] = 0
            continue
        out[i] = sum(
            1
            for j, w, s, _ in rows
            if w == u and s is not None and t - dt.timedelta(seconds=seconds) < s and (s < t or (s == t and j <= i))
        )
    return out


@pytest.mark.parametrize("dense", [None, 1])
def test_ties_and_bounds(spark, dense):
    rows = [
        (1, "a", at(0), "x"), (2, "a", at(0), "x"), (3, "a", at(3600), "x"), (4, "a", at(3599), "x"),
        (5, "b", at(1800), "x"), (6, "b", at(1800), "x"), (7, "b", at(5400), "x"), (8, "b", None, "x"),
        (9, None, at(5), "x"),
    ]
    got = trailing(events(spark, rows), dense_cell_rows=dense)
    assert got == {**expected_trailing(rows), 9: 1}
    assert got[2] == 2 and got[4] == 3 and got[3] == 2


@pytest.mark.parametrize("dense", [None, 1, 10_000])
def test_hot_user_random(spark, dense):
    """A third of the rows belong to one user, many within one hour."""
    rnd = random.Random(5)
    rows = [
        (i, "hot" if i % 3 == 0 else f"u{rnd.randrange(40)}", at(rnd.choice([rnd.randrange(4000), rnd.randrange(400000)])), "x")
        for i in range(900)
    ]
    assert trailing(events(spark, rows), dense_cell_rows=dense) == expected_trailing(rows)


def test_no_task_sees_a_whole_user(spark):
    """The window's keys include the time cell, so a user is spread over many groups."""
    df = events(spark, [(1, "a", at(0), "x")])
    out = windows.trailing_count(df, df.select("u", "t"), "u", "t", "id", "n")
    shown = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in shown
    for line in shown.splitlines():
        if "Window [" in line:
            assert "_cell" in line.rsplit("], [", 1)[-1] or "_cell" in line


@pytest.mark.parametrize("restart", [None, "day"])
def test_sequence(spark, restart):
    rnd = random.Random(1)
    rows = [(i, "a", at(rnd.randrange(300000)), "x") for i in range(300)] + [(300, "a", None, "x")]
    got = windows.sequence_by_time(events(spark, rows), "t", ["id"], restart=restart).collect()
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
    seen, expected = {}, {}
    for r in order:
        day = r[2].date() if restart and r[2] else None
        expected[r[0]] = seen.get(day, 0)
        seen[day] = expected[r[0]] + 1
    if restart:
        expected[300] = 0
        first = {}
        for r in order[1:]:
            d = r[2].date()
            expected[r[0]] = first.get(d, 0)
            first[d] = expected[r[0]] + 1
    assert {r["id"]: r["seq"] for r in got} == expected


def test_previous_values(spark):
    rnd = random.Random(2)
    rows = [(i, f"u{rnd.randrange(5)}", at(rnd.randrange(90000)), rnd.choice("abc")) for i in range(200)]
    got = windows.previous_values(events(spark, rows), "u", "t", "id", "v", 3).collect()
    for r in got:
        past = sorted((x for x in rows if x[1] == r["u"] and (x[2], x[0]) < (r["t"], r["id"])), key=lambda x: (x[2], x[0]))
        want = [x[3] for x in reversed(past)][:3] + [None] * 3
        assert [r["prev_1"], r["prev_2"], r["prev_3"]] == want[:3]


def test_previous_values_with_one_key(spark):
    """One key fills every range; look-back crosses range borders."""
    df = spark.range(2000).select(
        F.col("id"), F.lit("a").alias("u"), (F.lit(T0).cast("timestamp")).alias("t"), F.col("id").cast("string").alias("v")
    )
    out = windows.previous_values(df.repartition(8), "u", "t", "id", "v", 2)
    wrong = out.where(
        ~F.col("prev_1").eqNullSafe(F.when(F.col("id") >= 1, (F.col("id") - 1).cast("string")))
        | ~F.col("prev_2").eqNullSafe(F.when(F.col("id") >= 2, (F.col("id") - 2).cast("string")))
    )
    assert out.count() == 2000 and wrong.count() == 0


def test_ranges_stay_even_for_one_key_and_instant(spark):
    df = spark.range(8000).select("id", F.lit("a").alias("u"), F.lit(T0).alias("t"))
    sizes = [r["count"] for r in windows.in_order(df, ["u", "t", "id"]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_last_before(spark):
    rnd = random.Random(3)
    rows = [(i, f"u{rnd.randrange(4)}", at(rnd.randrange(90000)), "x") for i in range(150)]
    marks = [(f"u{rnd.randrange(4)}", at(rnd.randrange(90000))) for _ in range(20)] + [("u1", rows[0][2])]
    mdf = spark.createDataFrame(marks, "u string, t timestamp")
    for r in windows.last_before(events(spark, rows), mdf, "u", "t", "seen").collect():
        want = max((t for u, t in marks if u == r["u"] and t <= r["t"]), default=None)
        assert r["seen"] == want


def test_sessions(spark):
    rows = [(1, "a", at(0), "x"), (2, "a", at(1799), "x"), (3, "a", at(1799 + 1800), "x"), (4, "b", at(10), "x")]
    got = windows.sessions(events(spark, rows), "u", "t", 30).select("u", "session_start", "last_event", "events")
    assert {tuple(r) for r in got.collect()} == {
        ("a", at(0), at(1799), 2), ("a", at(3599), at(3599), 1), ("b", at(10), at(10), 1),
    }


def test_repeated_rows_of_one_user_stay_their_own(spark):
    """Rows stored twice count twice for their user and for nobody else, on either path."""
    rows = [(1, 0, 10), (1, 0, 10), (1, 60, 11), (1, 60, 11), (2, 30, 12), (2, 90, 13), (3, None, 14)]
    df = spark.createDataFrame(rows, "u int, s int, id int").select("u", "id", F.timestamp_seconds("s").alias("t"))

    def counted(**kw):
        out = windows.trailing_count(df, df.select("u", "t").distinct(), "u", "t", "id", "n", **kw)
        return sorted((r.u, r.id, r.n) for r in out.collect())

    want = [(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, 11, 4), (2, 12, 1), (2, 13, 2), (3, 14, 0)]
    assert counted() == want
    assert counted(dense_cell_rows=1) == want
