"""Ranking of anomalies and assembly of alerts with evidence and narrative."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.numeric import fixed, round_to
from wardline import dims
from wardline.functions import scoring
from wardline.functions.text import time_cell
from wardline.operators.attribution import top_features
from wardline.operators.joins import with_context, with_labels
from wardline.operators.windows import last_before, previous_values
from wardline.session import materialize

MIN_COMPUTED = 50
TTL_SECONDS = 3600


def most_anomalous(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest scores among predicted anomalies; ties by access_id.

    A top-k report: Spark keeps ``limit`` rows per task and merges them.
    """
    hits = scored.where(F.col("prediction") == -1)
    return hits.orderBy("anomaly_score", "access_id").limit(limit)


def feature_title(name: Column) -> Column:
    return _text_of(name, 0, F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def feature_text(name: Column) -> Column:
    fallback = F.concat(
        F.lower(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" is out of the ordinary")
    )
    return _text_of(name, 1, fallback)


def _text_of(name: Column, part: int, fallback: Column) -> Column:
    pairs = [F.lit(x) for f, text in dims.FEATURE_TEXT.items() for x in (f, text[part])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), fallback)


def evidence(top: Column) -> Column:
    """One line per top feature."""
    return F.transform(
        top, lambda e: F.concat(feature_title(e["feature"]), F.lit(": "), feature_text(e["feature"]), F.lit("."))
    )


def evidence_with_values(top: Column) -> Column:
    """The variant used when no context is at hand: it names the observed value."""
    return F.transform(
        top,
        lambda e: F.concat(
            feature_title(e["feature"]), F.lit(" - "), feature_text(e["feature"]),
            F.lit(" (observed "), fixed(e["event_value"], 4), F.lit(")"),
        ),
    )


def narrative(top: Column, score: Column, when: Column) -> Column:
    """Plain-language summary from band, person, place, time, asset, score and the main factors."""
    first, second = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    opening = F.concat(
        F.initcap(scoring.risk_band(score)), F.lit(" risk: "),
        scoring.display_user(F.col("username")), F.lit(" of "), F.col("department"),
        F.lit(" used "), scoring.display_asset(F.col("data_asset")),
        F.lit(" ("), F.lower("data_sensitivity"), F.lit(" data) on "), scoring.display_time(when),
        F.lit(". Risk score "), score.cast("string"), F.lit(" of 100."),
    )
    factor = lambda intro, e: F.concat(
        F.lit(intro), feature_title(e["feature"]), F.lit(", "), feature_text(e["feature"]), F.lit(".")
    )
    main = F.when(F.size(top) > 0, factor(" Main factor: ", first)).otherwise(
        F.lit(" No main factor is known.")
    )
    other = F.when(F.size(top) > 1, factor(" Also: ", second)).otherwise(F.lit(""))
    return F.concat(opening, main, other)


def plain_narrative(top: Column, raw: Column) -> Column:
    """Rule-based text that needs the score and, if there is one, the main factor."""
    shown = fixed(raw, 4)
    first = F.get(top, F.lit(0))["feature"]
    explained = F.concat(
        F.lit("Anomalous event with raw score "), shown, F.lit(". Main factor: "),
        feature_title(first), F.lit(", "), feature_text(first), F.lit("."),
    )
    bare = F.concat(F.lit("Anomalous event with raw score "), shown, F.lit(". No factors are known."))
    return F.when(F.size(top) > 0, explained).otherwise(bare)


def assemble_alerts(explained: DataFrame, logs: DataFrame, labels: DataFrame) -> DataFrame:
    """Nested alert rows: context, scores, top features, narrative and ground truth."""
    joined = with_labels(with_context(explained, logs), labels)
    rated = joined.withColumns(
        {
            "risk_score": scoring.risk_score(F.col("anomaly_score")),
            "top_shap_features": top_features(F.col("attribution")),
            "_when": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        }
    )
    top, score = F.col("top_shap_features"), F.col("risk_score")
    story = F.struct(
        narrative(top, score, F.col("_when")).alias("threat_narrative"),
        evidence(top).alias("evidence_list"),
        scoring.recommended_action(F.col("anomaly_score")).alias("recommended_action"),
    )
    return rated.select(
        "access_id",
        F.col("user_id").cast("string").alias("user_id"),
        "username",
        "department",
        F.col("_when").alias("timestamp"),
        "data_asset",
        "data_sensitivity",
        "query_type",
        "destination",
        round_to("anomaly_score", 6).alias("anomaly_score"),
        "risk_score",
        (F.col("prediction") == -1).alias("is_anomaly_predicted"),
        "prediction",
        "top_shap_features",
        story.alias("narrative"),
        F.struct("is_anomaly", "anomaly_type", "severity", "explanation").alias("ground_truth"),
    )


def one_per_content(
    df: DataFrame, hash_col: str, ts: str, order: list[str], ttl_seconds: int = TTL_SECONDS
) -> DataFrame:
    """The event that is evaluated for each content and interval of ``ttl_seconds``.

    Its result serves the copies of the same interval, so none is older than the time to live. The
    representative is a grouped minimum, combined before the shuffle: content that repeats very
    often is no hot spot.
    """
    cells = df.withColumn("ttl_cell", time_cell(F.col(ts), ttl_seconds))
    pick = cells.groupBy(hash_col, "ttl_cell").agg(
        F.min(F.struct(*order)).alias("_rep"), F.count("*").alias("copies")
    )
    return pick.select(hash_col, "ttl_cell", "_rep.*", "copies")



LONG_RUN = 1_000_000  # distinct times of one content without a pause that a task goes through in order


def evaluation_starts(times: DataFrame, key: str, ts: str, ttl_seconds: int = TTL_SECONDS, long_run: int = LONG_RUN) -> DataFrame:
    """(key, ts) of the evaluations: the first time of a content, then each first one after the result has expired.

    ``times`` has distinct (key, ts). After a pause of a time to live an evaluation begins in any case, so a content's
    times fall into independent runs. A run is gone through in order, holding one time; one of more than ``long_run``
    times is resolved by pointers instead: each time points to the first one after its expiry, and those reached from
    the run's start are found by doubling the pointers, so no task has the run.
    """
    ttl = F.make_interval(secs=F.lit(ttl_seconds))
    slim = times.select(key, F.col(ts).cast("timestamp").alias("at")).where("at IS NOT NULL")
    seen = previous_values(slim.withColumn("was", F.col("at")), key, "at", "was", "was", 1)
    heads = materialize(seen.where(F.col("prev_1").isNull() | (F.col("at") >= F.col("prev_1") + ttl)).select(key, "at"), "heads")
    runs = materialize(last_before(slim, heads, key, "at", "head"), "runs")
    sizes = runs.groupBy(key, "head").agg(F.count("*").alias("n"))
    long = materialize(sizes.where(F.col("n") > long_run).select(key, "head"), "long_runs")
    if long.isEmpty():
        return _greedy(runs, key, ttl_seconds)
    same = ["head", key]
    short = _greedy(runs.join(long, same, "left_anti"), key, ttl_seconds)
    return short.unionByName(_reached(runs.join(long, same, "left_semi"), key, ttl))


def _greedy(runs: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """Starts within runs (key, at, head), each run in order."""
    ttl = ttl_seconds * 1_000_000

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, until = None, 0
        for batch in batches:
            kept = []
            heads = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            for i, (here, at) in enumerate(zip(heads, batch.column(3).to_pylist())):
                if here != run or at >= until:
                    run, until = here, at + ttl
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    dealt = runs.select(key, "at", "head", F.unix_micros("at").alias("micros")).repartition(key, "head")
    ordered = dealt.sortWithinPartitions(key, "head", "at")
    return ordered.mapInArrow(pick, ordered.schema).select(key, "at")


def _reached(runs: DataFrame, key: str, ttl: Column) -> DataFrame:
    """Starts within runs, by doubling the pointers from each time to the first one after its expiry."""
    mirrored = lambda c: F.timestamp_micros(-F.unix_micros(c))  # noqa: E731  # the first after is the last before
    nodes = materialize(runs.select(key, "at", "head"), "nodes")
    marks = nodes.select(key, mirrored(F.col("at")).alias("expires"))
    asked = nodes.withColumn("expires", mirrored(F.col("at") + ttl))
    found = last_before(asked, marks, key, "expires", "follows")
    jumps = found.select(key, "at", mirrored(F.col("follows")).alias("to")).where("to IS NOT NULL")
    # a pointer out of its run leads to the next run's start, which is reached anyway
    jumps = materialize(jumps, "jumps")
    reached = materialize(nodes.where(F.col("at") == F.col("head")).select(key, "at"), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, [key, "at"]).select(key, F.col("to").alias("at"))
        reached = materialize(reached.unionByName(more).distinct(), "reached")
        onward = jumps.select(key, F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(onward, [key, "to"]).select(key, "at", F.col("beyond").alias("to")), "jumps")
    return reached


def from_first_evaluation(df: DataFrame, hash_col: str, ts: str, order: str, ttl_seconds: int = TTL_SECONDS, long_run: int = LONG_RUN) -> DataFrame:
    """A row for each evaluation: content, its time, the event evaluated, and how many events its result serves.

    A result serves the content's events less than ``ttl_seconds`` after the event it was made for, and the next
    one is evaluated anew. Events without a time are not looked at.
    """
    at = F.col(ts).cast("timestamp")
    moments = df.where(at.isNotNull()).groupBy(hash_col, at.alias("at")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    moments = materialize(moments, "moments")
    starts = materialize(evaluation_starts(moments, hash_col, "at", ttl_seconds, long_run), "starts")
    served = last_before(moments, starts, hash_col, "at", "evaluated_at")
    return served.groupBy(hash_col, "evaluated_at").agg(F.min_by(order, "at").alias(order), F.sum("copies").alias("copies"))
