"""Chains of evaluations, rolling boards, known periods, expectations without the judged day, shifts."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators import baselines, rules, triage

START = dt.datetime(2024, 3, 30)
HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize("long_run", [1_000_000, 5])
def test_evaluations_chain_from_the_first(spark, long_run):
    """In order or by doubled pointers; pauses, repeated instants, expiry to the microsecond, nulls."""
    rnd = random.Random(1)
    rows = [(i, "busy", START + dt.timedelta(minutes=rnd.randrange(3000))) for i in range(700)]
    rows += [(1000 + i, rnd.choice("abcde"), START + dt.timedelta(hours=rnd.randrange(60), minutes=rnd.choice([0, 30, 59]))) for i in range(200)]
    rows += [(2000 + i, "edge", START + i * HOUR - dt.timedelta(microseconds=i % 2)) for i in range(9)]
    rows += [(3000, "once", START), (3001, "once", None), (3002, None, START), (3003, None, START)]
    by_content = defaultdict(list)
    for i, c, t in rows:
        if t is not None:
            by_content[c].append((t, i))
    want = Counter()
    for c, events in by_content.items():
        start, first, n = None, None, 0
        for t, i in sorted(events):
            if start is None or t >= start + HOUR:
                if n:
                    want[c, start, first, n] += 1
                start, first, n = t, i, 0
            n += 1
        want[c, start, first, n] += 1
    df = spark.createDataFrame(rows, "access_id long, content string, timestamp timestamp")
    got = triage.from_first_evaluation(df, "content", "timestamp", "access_id", long_run=long_run)
    assert Counter((r.content, r.evaluated_at, r.access_id, r.copies) for r in got.collect()) == want


def test_board_counts_a_burst_over_four_dates(spark):
    at = [dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 5), dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 4, 22, 59)]
    rows = [("u", t, "CRITICAL", True) for t in at] + [("v", at[0], "HIGH", True), ("w", at[0], "HIGH", False)]
    typed = spark.createDataFrame(rows, "user_id string, timestamp timestamp, severity string, is_anomaly boolean")
    board = baselines.riskiest_users_hourly(typed, top=1)
    best = {r.as_of: (r.user_id, r.alerts, r.critical) for r in board.collect()}
    assert best[dt.datetime(2024, 1, 4, 23)] == ("u", 4, 4) and best[dt.datetime(2024, 1, 5)] == ("u", 3, 3)
    assert min(best) == dt.datetime(2024, 1, 2) and max(best) == dt.datetime(2024, 1, 7, 22)
    assert baselines.riskiest_users_hourly(typed.limit(0)).collect() == []


def test_known_periods_that_overlap(spark):
    rnd = random.Random(7)
    periods = [(rnd.choice("abc"), s, s + dt.timedelta(minutes=rnd.choice([-5, 0, 30, 200]))) for s in (START + dt.timedelta(minutes=10 * rnd.randrange(400)) for _ in range(60))]
    periods += [("a", None, START), ("a", START, None), (None, START, START + 90 * HOUR), ("hot", START, START + HOUR)]
    hits = [(i, rnd.choice(["a", "b", "c", "d", None]), START + dt.timedelta(minutes=5 * rnd.randrange(900)), "r") for i in range(600)]
    hits += [(5000 + i, "hot", START + dt.timedelta(seconds=i), "r") for i in range(5000)] + [(9999, "a", None, "r")]
    inside = {i for i, u, t, _ in hits for p, s, e in periods if u is not None and p == u and s and e and t and s <= t <= e}
    df = spark.createDataFrame(hits, "access_id long, user_id string, timestamp timestamp, rule_id string")
    known = spark.createDataFrame(periods, "user_id string, starts timestamp, ends timestamp")
    out = rules.outside_context(df, known)
    assert out.columns == df.columns
    assert sorted(r.access_id for r in out.collect()) == sorted(i for i, *_ in hits if i not in inside)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_judged_day_is_no_part_of_its_expectation(spark):
    days = {"2024-04-01": 3, "2024-04-08": 5, "2024-04-15": 10, "2024-04-16": 7, "2024-04-30": 2}
    rows = [("u", dt.datetime.fromisoformat(d)) for d, n in days.items() for _ in range(n)] + [("one", dt.datetime(2024, 4, 2))]
    got = {(r.user_id, str(r.day)): (r.expected, r.rate) for r in baselines.seasonal_rate_left_out(spark.createDataFrame(rows, "user_id string, timestamp timestamp").withColumn("access_id", F.monotonically_increasing_id()).withColumn("rowcount", F.lit(1))).collect()}
    assert got["u", "2024-04-15"] == (4.0, 2.5)  # the other Mondays
    assert got["u", "2024-04-16"] == (6.0, round(7 / 6, 4))  # no other Tuesday: the other ordinary days
    assert got["u", "2024-04-30"] == (None, None) and got["one", "2024-04-02"] == (None, None)


def test_a_planted_shift_ranks_first(spark):
    rnd = random.Random(2)
    rows = []
    for user in range(12):
        for k in range(300):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * k)
            recent = at > dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * 299) - dt.timedelta(days=7)
            kinds = ["EXPORT", "DELETE"] if user == 5 and recent else ["SELECT", "UPDATE"]
            rows.append((len(rows), user, at, rnd.choice(kinds)))
    shifts = baselines.action_shifts(spark.createDataFrame(rows, "access_id long, user_id long, timestamp timestamp, query_type string"))
    ranked = sorted(((r.shift, r.user_id) for r in shifts.collect()), reverse=True)
    assert ranked[0][1] == 5 and ranked[0][0] > 0.95 and ranked[1][0] < 0.5
