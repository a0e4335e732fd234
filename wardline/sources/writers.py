"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def write_enriched(enriched: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by day. Rebalancing gives each day few files and splits a day that is large."""
    dated = enriched.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def write_raw(df: DataFrame, schema: T.StructType, path: str, fmt: str = "csv") -> None:
    """A raw table with its fixed column order and types."""
    ordered = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    writer = ordered.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    writer.save(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Nested alerts as JSON lines."""
    alerts.write.mode("errorifexists").json(path)


def alerts_as_json(alerts: DataFrame) -> DataFrame:
    return alerts.select("access_id", F.to_json(F.struct(*alerts.columns)).alias("alert"))
