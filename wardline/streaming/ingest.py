"""Stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline import schemas
from wardline.functions.text import time_class


def log_files(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LOGS, fmt: str = "parquet", **options
) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def log_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A Kafka topic of JSON log rows; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return parse_events(raw.select(F.col("value").cast("string").alias("value")), "value")


# Values a partial event gets for missing fields.
DEFAULTS = {
    "data_sensitivity": "low",
    "query_type": "SELECT",
    "rowcount": 0,
    "destination": "local_workstation",
    "status": "success",
    "authentication_method": "SSO",
    "is_vpn": False,
}


def parse_events(df: DataFrame, column: str) -> DataFrame:
    """JSON text to log rows. Missing fields get defaults; a missing time class follows the time."""
    row = F.from_json(column, schemas.LOGS)
    filled = df.select(row.alias("_e")).select("_e.*")
    filled = filled.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return filled.withColumn(
        "time_classification", F.coalesce("time_classification", time_class(F.col("timestamp")))
    )
