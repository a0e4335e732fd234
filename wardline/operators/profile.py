"""Aggregations that describe a table: ranges, counts, cross-tabs and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.numeric import round_to
from wardline.functions.text import clean
from wardline import dims
from wardline.operators.quantiles import exact_quantiles


def _per_feature(df: DataFrame, features: list[str], measures: dict) -> DataFrame:
    """One aggregate per feature. Columns become rows and are combined map-side, which is faster
    than one very wide aggregation whose generated code is too long to be compiled."""
    rows = df.select(F.posexplode(F.array(*features)).alias("_i", "_v"))
    totals = rows.groupBy("_i").agg(*[make(F.col("_v")).alias(n) for n, make in measures.items()])
    name = F.get(F.array(*map(F.lit, features)), F.col("_i"))
    return totals.select(name.alias("feature"), *measures)


def feature_ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """Minimum, maximum, non-zero rows and rows of each feature."""
    return _per_feature(
        df,
        features,
        {
            "min_value": F.min,
            "max_value": F.max,
            "nonzero": lambda c: F.count_if(c != 0),
            "total": lambda c: F.count(c),
        },
    )


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, to 3 decimals."""
    basics = _per_feature(
        df,
        features,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
        },
    )
    quartiles = (
        exact_quantiles(df, features, [0.25, 0.5, 0.75])
        .groupBy("feature")
        .pivot("q", [0.25, 0.5, 0.75])
        .agg(F.first("value"))
        .toDF("feature", "p25", "p50", "p75")
    )
    r3 = lambda c: round_to(F.col(c).cast("double"), 3).alias(c)
    return basics.join(quartiles, "feature").select(
        "feature", "count", *[r3(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]]
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """Range, mean and population deviation of the scores, and how many are anomalies."""
    hit = F.col("prediction") == -1
    return scored.agg(
        F.min("anomaly_score").alias("min_score"),
        F.max("anomaly_score").alias("max_score"),
        F.avg("anomaly_score").alias("mean_score"),
        F.stddev_pop("anomaly_score").alias("std_score"),
        F.count_if(hit).alias("anomalies"),
        F.count("*").alias("total"),
        F.avg(hit.cast("double")).alias("share"),
    )


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts of each value of several columns, in one pass (grouping sets)."""
    tagged = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sets = [[F.col(c)] for c in columns]
    grouped = tagged.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.count("*").alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    name = reduce(lambda acc, c: acc.when(F.col(f"_g_{c}") == 0, c), columns, F)
    value = reduce(lambda acc, c: acc.when(F.col(f"_g_{c}") == 0, F.col(c)), columns, F)
    counted = grouped.select(name.alias("dimension"), value.alias("value"), "n")
    return counted.orderBy("dimension", F.desc("n"), "value")


def user_conditions(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count_if(F.col("notice_period")).alias("on_notice"),
        F.count_if(F.col("failed_logins_30d") >= 5).alias("many_failed_logins"),
        F.count_if(F.col("vpn_user")).alias("vpn_users"),
        F.count_if(~F.col("security_training_current")).alias("training_missing"),
    )


def event_conditions(logs: DataFrame) -> DataFrame:
    external_ip = ~F.coalesce(F.col("source_ip"), F.lit("")).startswith("10.")
    return logs.agg(
        F.count_if(clean(F.col("destination")).isin(dims.EXTERNAL_DESTINATIONS)).alias("external_dest"),
        F.count_if(external_ip).alias("external_ip"),
        F.count_if(clean(F.col("geo_location")).isin(dims.SUSPICIOUS_GEO)).alias("suspicious_geo"),
    )


def share(df: DataFrame, flag: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(flag).alias("flagged"),
        F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias("share"),
    )


def severity_counts(labels: DataFrame) -> DataFrame:
    """Rows per severity and in all, as rows (severity, n)."""
    rolled = labels.rollup("severity").agg(F.count("*").alias("n"), F.grouping("severity").alias("_g"))
    return rolled.select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("severity")).alias("severity"), "n"
    )


def cross_tab(logs: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by a fixed list of column values; missing combinations are 0."""
    table = logs.groupBy(rows).pivot(column, values).count()
    return table.na.fill(0, values)


def hour_histogram(logs: DataFrame, time_classes: list[str]) -> DataFrame:
    """Events per hour of day and time class, with all 24 hours present."""
    spark = logs.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    spine = hours.withColumn("time_classification", F.explode(F.array(*map(F.lit, time_classes))))
    counted = logs.groupBy("time_classification", F.hour("timestamp").alias("hour")).agg(
        F.count("*").alias("n")
    )
    return spine.join(counted, ["time_classification", "hour"], "left").select(
        "time_classification", "hour", F.coalesce("n", F.lit(0)).alias("n")
    )


def histograms(
    df: DataFrame, columns: list[str], bins: int, by: list[str] | None = None
) -> DataFrame:
    """Equal-width histograms between each column's extremes; the last bin is closed.

    The extremes (two numbers per column) become literals, so the second pass is a map-side
    combined count of (column, bin).
    """
    by = by or []
    ends = df.agg(*[F.struct(F.min(c), F.max(c)) for c in columns]).head()

    def cell(c: str, lo, hi) -> Column:
        lo, hi = (float(lo), float(hi)) if lo is not None else (0.0, 0.0)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        place = F.floor((F.col(c).cast("double") - lo) / (hi - lo) * bins)
        spot = F.least(place, F.lit(bins - 1)).cast("int")
        # no value, no bin
        return F.struct(F.lit(c).alias("feature"), spot.alias("bin"))

    cells = F.array(*[cell(c, *ends[i]) for i, c in enumerate(columns)])
    spread = df.select(*by, F.inline(cells)).where(F.col("bin").isNotNull())
    return spread.groupBy(*by, "feature", "bin").agg(F.count("*").alias("n"))
