"""Behavioural baselines: what is usual for a user, a peer group or a phase of the calendar.

Events are reduced to (user, day) or finer calendar cells before any window over a user, so such
a window's length is bounded by the calendar and not by the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.functions.numeric import round_to
from wardline.operators.joins import join_statistics
from wardline.operators.quantiles import exact_quantiles_by
from wardline.session import materialize
from wardline.operators.windows import MICROS, micros, previous_values, trailing_count

EPOCH = "1970-01-01"


def _day(ts: str = "timestamp") -> Column:
    return F.to_date(F.col(ts).cast("timestamp"))


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def daily_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("user_id", _day().alias("day")).agg(F.count("*").alias("n"))


def daily_rate(logs: DataFrame, days: int = 30) -> DataFrame:
    """Daily events over the mean of the user's active days in the ``days`` before."""
    daily = daily_counts(logs).withColumn("_d", _day_number(F.col("day")))
    past = Window.partitionBy("user_id").orderBy("_d").rangeBetween(-days, -1)
    usual = F.avg("n").over(past)
    return daily.select(
        "user_id", "day", "n",
        round_to(usual, 4).alias("usual"),
        round_to(F.try_divide(F.col("n"), usual), 4).alias("rate"),
    )


def user_deviations(
    logs: DataFrame, measures: list[str], rows_per_salt: int | None = None
) -> DataFrame:
    """Per event: z-score of each measure for its user, IQR outlier marks, mean |z|.

    Means, deviations and quartiles are per-user aggregates joined back to the events.
    """
    stats = logs.groupBy("user_id").agg(
        F.count("*").alias("_rows"),
        *[F.avg(m).alias(f"_{m}_mean") for m in measures],
        *[F.stddev_pop(m).alias(f"_{m}_std") for m in measures],
    )
    quartiles = exact_quantiles_by(logs, ["user_id"], measures, [0.25, 0.75], rows_per_salt)
    fences = quartiles.groupBy("user_id").agg(
        *[
            F.max(F.when((F.col("feature") == m) & (F.col("q") == q), F.col("value"))).alias(f"_{m}_{tag}")
            for m in measures
            for q, tag in [(0.25, "q1"), (0.75, "q3")]
        ]
    )
    both = stats.join(fences, "user_id")
    slim = logs.select("access_id", "user_id", *measures)
    joined = join_statistics(slim, both, ["user_id"], "_rows", ["access_id"], rows_per_salt)

    def z(m: str) -> Column:
        gap = F.col(m) - F.col(f"_{m}_mean")
        return F.when(F.col(f"_{m}_std") > 0, gap / F.col(f"_{m}_std")).otherwise(0.0)

    def outlier(m: str) -> Column:
        q1, q3 = F.col(f"_{m}_q1"), F.col(f"_{m}_q3")
        reach = (q3 - q1) * 1.5
        return ((F.col(m) < q1 - reach) | (F.col(m) > q3 + reach)).cast("int")

    total = sum((F.abs(z(m)) for m in measures[1:]), F.abs(z(measures[0])))
    return joined.select(
        "access_id", "user_id",
        *[round_to(z(m), 4).alias(f"z_{m}") for m in measures],
        *[outlier(m).alias(f"outlier_{m}") for m in measures],
        round_to(total / len(measures), 4).alias("deviation"),
    )


def first_month_baseline(logs: DataFrame, measure: str, days: int = 30) -> DataFrame:
    """Per user: events and mean of a measure in the first ``days`` days and after them."""
    daily = logs.groupBy("user_id", _day().alias("day")).agg(
        F.count("*").alias("n"), F.sum(measure).alias("s")
    )
    start = F.min("day").over(Window.partitionBy("user_id"))
    early = F.datediff("day", "start") < days
    by_user = daily.withColumn("start", start).groupBy("user_id").agg(
        F.min("start").alias("baseline_from"),
        F.coalesce(F.sum(F.when(early, F.col("n"))), F.lit(0)).alias("baseline_events"),
        F.sum(F.when(early, F.col("s"))).alias("_s0"),
        F.coalesce(F.sum(F.when(~early, F.col("n"))), F.lit(0)).alias("later_events"),
        F.sum(F.when(~early, F.col("s"))).alias("_s1"),
    )
    base = F.try_divide(F.col("_s0").cast("double"), F.col("baseline_events").cast("double"))
    later = F.try_divide(F.col("_s1").cast("double"), F.col("later_events").cast("double"))
    return by_user.select(
        "user_id", "baseline_from", "baseline_events", "later_events",
        round_to(base, 4).alias("baseline_mean"),
        round_to(later, 4).alias("later_mean"),
        round_to(F.try_divide(later, base), 4).alias("change"),
    )


def asset_returns(logs: DataFrame, idle_days: int = 180) -> DataFrame:
    """First-ever use of an asset by a user, and uses after at least ``idle_days`` without one.

    A pause of a day or more shows between the last event of one day and the first of the next
    active day, so (user, asset, day) rows are enough to find it exactly.
    """
    at = F.col("timestamp").cast("timestamp")
    daily = logs.groupBy("user_id", "data_asset", _day().alias("day")).agg(
        F.min(F.struct(at.alias("at"), F.col("access_id"))).alias("first"), F.max(at).alias("last")
    )
    order = Window.partitionBy("user_id", "data_asset").orderBy("day")
    pause = (F.unix_micros("first.at") - F.unix_micros(F.lag("last").over(order))) / (86_400 * MICROS)
    marked = daily.withColumn("_pause", pause)
    return marked.where(F.col("_pause").isNull() | (F.col("_pause") >= idle_days)).select(
        F.col("first.access_id").alias("access_id"),
        "user_id", "data_asset", "day",
        F.col("_pause").isNull().alias("first_time"),
        round_to("_pause", 4).alias("idle_days"),
    )


def calendar_phase(day: Column) -> Column:
    """quarter_end / month_end for the last three days of the period, else ordinary."""
    closing = F.datediff(F.last_day(day), day) < 3
    return (
        F.when(closing & (F.month(day) % 3 == 0), "quarter_end")
        .when(closing, "month_end")
        .otherwise("ordinary")
    )


def seasonal_rate(logs: DataFrame) -> DataFrame:
    """Daily events against the user's own mean for the same phase of the calendar."""
    daily = daily_counts(logs).withColumn("phase", calendar_phase(F.col("day")))
    usual = F.avg("n").over(Window.partitionBy("user_id", "phase"))
    return daily.select(
        "user_id", "day", "phase", "n",
        round_to(usual, 4).alias("expected"),
        round_to(F.col("n") / usual, 4).alias("rate"),
    )


def seasonal_rate_left_out(logs: DataFrame) -> DataFrame:
    """Daily events against the user's other days of the same phase and weekday.

    The judged day is no part of its own expectation. Without another such day the other days of the phase
    count, without any the expectation and the rate are null.
    """
    daily = daily_counts(logs).withColumns({"phase": calendar_phase(F.col("day")), "weekday": F.weekday("day")})

    def others(*keys: str) -> Column:
        same = Window.partitionBy("user_id", *keys)
        return (F.sum("n").over(same) - F.col("n")) / F.nullif(F.count("*").over(same) - 1, F.lit(0))

    rated = daily.withColumn("usual", F.coalesce(others("phase", "weekday"), others("phase")))
    return rated.select(
        "user_id", "day", "phase", "n",
        round_to("usual", 4).alias("expected"),
        round_to(F.col("n") / F.col("usual"), 4).alias("rate"),
    )


def riskiest_users(labelled: DataFrame, top: int = 10, days: int = 3) -> DataFrame:
    """Leaderboard per day: users with most anomalies in the ``days`` calendar days up to it."""
    daily = (
        labelled.where(F.col("is_anomaly"))
        .groupBy("user_id", _day().alias("day"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c"))
    )
    # every alert counts on its own day and on the days its window still covers
    spread = daily.select(
        "user_id", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"), "n", "c"
    )
    board = spread.groupBy("day", "user_id").agg(
        F.sum("n").alias("alerts"), F.sum("c").alias("critical")
    )
    order = Window.partitionBy("day").orderBy(F.desc("alerts"), F.desc("critical"), "user_id")
    return board.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def riskiest_users_hourly(labelled: DataFrame, top: int = 10, hours: int = 72) -> DataFrame:
    """Leaderboard at the end of each hour: users with most anomalies in the ``hours`` hours up to it.

    Anomalies are counted per user and hour. An hour's counts arrive with it and leave ``hours`` later, so a running
    sum over a user's hours gives the board from one change to the next; nothing is summed twice.
    """
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp"))
    hourly = labelled.where(F.col("is_anomaly")).groupBy("user_id", hour.alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("c")
    )
    later = F.col("hour") + F.make_interval(hours=F.lit(hours))
    steps = hourly.where("hour IS NOT NULL").select("user_id", F.inline(F.array(
        F.struct("hour", "n", "c"), F.struct(later.alias("hour"), (-F.col("n")).alias("n"), (-F.col("c")).alias("c"))
    )))
    order = Window.partitionBy("user_id").orderBy("hour")
    sums = steps.groupBy("user_id", "hour").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).select(
        "user_id", "hour", F.sum("n").over(order).alias("alerts"), F.sum("c").over(order).alias("critical"),
        F.lead("hour").over(order).alias("until"),
    )
    one = F.make_interval(hours=F.lit(1))
    board = sums.where("alerts > 0").withColumn("hour", F.explode(F.sequence(F.col("hour"), F.col("until") - one, one)))
    best = Window.partitionBy("hour").orderBy(F.desc("alerts"), F.desc("critical"), "user_id")
    placed = board.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return placed.select((F.col("hour") + one).alias("as_of"), "user_id", "alerts", "critical", "place")


def daily_report(labelled: DataFrame) -> DataFrame:
    anomalies = labelled.where(F.col("is_anomaly"))
    return anomalies.groupBy(_day().alias("day")).agg(
        F.count("*").alias("alerts"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ["CRITICAL", "HIGH", "MEDIUM"]],
        F.countDistinct("user_id").alias("users"),
    )


def peer_deviation(logs: DataFrame, measure: str) -> DataFrame:
    """Each user's mean of a measure against the other users of the department."""
    per_user = logs.groupBy("department", "user_id").agg(F.avg(measure).alias("own_mean"))
    peers = per_user.groupBy("department").agg(
        F.avg("own_mean").alias("_mean"), F.stddev_pop("own_mean").alias("_std"), F.count("*").alias("peers")
    )
    gap = F.col("own_mean") - F.col("_mean")
    z = F.when(F.col("_std") > 0, gap / F.col("_std")).otherwise(0.0)
    return per_user.join(peers, "department").select(
        "department", "user_id", "peers",
        round_to("own_mean", 4).alias("own_mean"),
        round_to(z, 4).alias("z"),
    )


def user_groups(logs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """KMeans groups of users by standardised activity totals."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    hour = F.hour("timestamp")
    per_user = logs.groupBy("user_id").agg(
        F.log1p(F.count("*")).alias("events"),
        F.log1p(F.avg("rowcount")).alias("rows"),
        F.avg(((hour < 8) | (hour >= 18)).cast("double")).alias("off_hours"),
        F.avg((F.col("status") != "success").cast("double")).alias("failures"),
    )
    stages = [
        VectorAssembler(inputCols=["events", "rows", "off_hours", "failures"], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="group"),
    ]
    fitted = Pipeline(stages=stages).fit(per_user)
    return fitted.transform(per_user).drop("_raw", "features")


def risk_trend(labelled: DataFrame) -> DataFrame:
    """Slope of the daily share of anomalies per user: above zero means rising risk."""
    daily = labelled.groupBy("user_id", _day().alias("day")).agg(
        F.avg(F.col("is_anomaly").cast("double")).alias("risk")
    )
    x = _day_number(F.col("day")).cast("double")
    return daily.groupBy("user_id").agg(
        F.count("*").alias("days"), round_to(F.regr_slope("risk", x), 6).alias("slope")
    )


def failure_bursts(logs: DataFrame, seconds: int = 600, at_least: int = 2) -> DataFrame:
    """Failed accesses with ``at_least`` failures of the user within the trailing window."""
    failed = logs.where(F.lower("status") != "success").select("access_id", "user_id", "timestamp")
    counted = trailing_count(
        failed, failed.select("user_id", "timestamp"), "user_id", "timestamp", "access_id", "failures", seconds
    )
    return counted.where(F.col("failures") >= at_least)


def pauses(logs: DataFrame) -> DataFrame:
    """Seconds since the user's previous event."""
    slim = logs.select("access_id", "user_id", "timestamp", F.col("timestamp").alias("_at"))
    before = previous_values(slim, "user_id", "timestamp", "access_id", "_at", 1)
    gap = (micros(F.col("timestamp")) - micros(F.col("prev_1"))) / MICROS
    return before.select("access_id", "user_id", round_to(gap, 3).alias("seconds_since_previous"))


def action_sequences(logs: DataFrame) -> DataFrame:
    """Three-step action sequences per user with how common each is overall."""
    slim = logs.select("access_id", "user_id", "timestamp", "query_type")
    steps = previous_values(slim, "user_id", "timestamp", "access_id", "query_type", 2)
    grams = steps.where(F.col("prev_2").isNotNull()).select(
        "user_id", F.concat_ws(">", "prev_2", "prev_1", "query_type").alias("sequence")
    )
    per_user = grams.groupBy("user_id", "sequence").agg(F.count("*").alias("n"))
    # users x sequences, far smaller than the events; stored because it is read twice
    per_user = materialize(per_user, "sequences")
    overall = per_user.groupBy("sequence").agg(
        F.sum("n").alias("total"), F.count("*").alias("users")
    )
    return per_user.join(overall, "sequence").select("user_id", "sequence", "n", "total", "users")


def action_shifts(logs: DataFrame, days: int = 7) -> DataFrame:
    """How far each user's steps from one action to the next differ between the last ``days`` days and before.

    Half the sum of absolute differences between the two shares of each step: 0 is no shift, 1 a wholly new
    pattern. Only users with steps in both periods are compared.
    """
    slim = logs.select("access_id", "user_id", "timestamp", "query_type")
    steps = previous_values(slim, "user_id", "timestamp", "access_id", "query_type", 1)
    steps = materialize(steps.where("prev_1 IS NOT NULL AND timestamp IS NOT NULL"), "steps")
    last = F.lit(steps.agg(F.max("timestamp")).first()[0]).cast("timestamp")
    recent = F.col("timestamp") > last - F.make_interval(days=F.lit(days))
    counts = steps.groupBy("user_id", F.concat_ws(">", "prev_1", "query_type").alias("step")).agg(
        F.count_if(recent).alias("now"), F.count_if(~recent).alias("before")
    )
    user = Window.partitionBy("user_id")
    shares = counts.withColumns({"all_now": F.sum("now").over(user), "all_before": F.sum("before").over(user)})
    gap = F.abs(F.col("now") / F.col("all_now") - F.col("before") / F.col("all_before"))
    both = shares.where("all_now > 0 AND all_before > 0")
    return both.groupBy("user_id").agg(
        F.first("all_now").alias("recent_steps"), F.first("all_before").alias("earlier_steps"), round_to(F.sum(gap) / 2, 4).alias("shift")
    )
