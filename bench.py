"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from wardline.catalog import REGISTRY
from wardline.catalog.registry import Inputs
from wardline.operators import attribution, forest
from wardline.plans import alerts, enrich, train
from wardline.schemas import FEATURES
from wardline.session import build_session, materialize
from wardline.sources import sample_views as views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
SQL_QUERIES = [
    "f17_temporal_velocity", "j2_orphans", "a1_feature_ranges", "a2_describe", "a4_counts_by",
    "a10_feature_histograms", "e2_classification_report", "d1_rules", "d3_daily_rate", "d4_deviations",
    "d9_riskiest_users", "d10_typed_anomalies", "d16_action_sequences", "d17_watch_list", "n5_json_salvage",
    "t2_narrative", "w2_resequence", "r2_stream_features",
]
COPIES = 10  # of the events, for the throughput figure


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def copies_of(logs, n: int):
    """The logs ``n`` times, each copy 30 days and one id range later."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return logs.withColumn("_copy", copy).withColumns(
        {
            "access_id": F.col("access_id") + F.col("_copy") * 10_000_000,
            "timestamp": F.col("timestamp") + F.make_interval(days=F.col("_copy") * 30),
        }
    ).drop("_copy")


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    q, times = Inputs(spark, SF_DIR), {}

    def timed(name, action):
        start = time.perf_counter()
        out = action()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
        return out

    # not timed: first use of the JVM's code paths and start of the Python workers
    run(q.enriched.limit(10))
    cores = int(CPUS)
    run(spark.range(cores).repartition(cores).mapInPandas(lambda batches: batches, "id long"))
    timed("enrich", lambda: run(q.enriched))
    stored = timed("enrich_and_store", lambda: q.stored)
    model, scored = timed("train_forest", lambda: forest.fit_forest(stored, "access_id", FEATURES))
    timed("score_all", lambda: run(model.score(stored)))
    fitted = train.Trained(model, scored)
    timed("alerts_top50", lambda: alerts.flagged_events(fitted, q.logs, q.labels).collect())
    reference = attribution.background_rows(stored, model, "access_id", 50)
    sample = forest.seeded_sample(stored, "access_id", 400)
    timed("attribute_400", lambda: run(attribution.explain(sample, model, reference)))
    for name in SQL_QUERIES:
        timed(name, lambda: run(REGISTRY[name].run(Inputs(spark, SF_DIR))))

    many = materialize(copies_of(q.logs, COPIES).repartition(int(CPUS) * 2), "bench_logs")
    n = many.count()
    timed(
        "enrich_and_score_copies",
        lambda: run(model.score(enrich.enrich(many, q.profiles, views.REFERENCE_DATE))),
    )
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("/", 1)[-1].removeprefix("sf"),
                "copies_events": n,
                "copies_events_per_sec": round(n / times["enrich_and_score_copies"]),
            }
        )
    )


if __name__ == "__main__":
    main()
