"""Scans with fixed schemas. Spark raises on a missing path; a missing column is reported here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline import schemas
from wardline.functions.text import truthy


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """CSV (header line, empty text as null), JSON, ORC or Parquet."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, nullValue="", emptyValue="", mode="PERMISSIVE")
        reader = reader.option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    return reader.format(fmt).load(path)


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.LOGS, fmt)


def read_profiles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PROFILES, fmt)


def read_event_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normalise_labels(read_table(spark, path, schemas.EVENT_LABELS, fmt))


def read_user_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return normalise_labels(read_table(spark, path, schemas.USER_LABELS, fmt))


def normalise_labels(labels: DataFrame) -> DataFrame:
    """``is_anomaly`` as a boolean whatever it was stored as; anything but true is false."""
    return labels.withColumn("is_anomaly", truthy(F.col("is_anomaly")) == 1)


def feature_matrix(enriched: DataFrame, features: list[str] | None = None) -> DataFrame:
    """The model's columns as doubles: booleans and "True"/"False" to 1/0, nulls and NaN to 0."""
    features = features or schemas.FEATURES
    kinds = dict(enriched.dtypes)

    def number(c: str):
        if kinds[c] in ("boolean", "string"):
            return truthy(F.col(c)).cast("double").alias(c)
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)

    return enriched.select(
        *[c for c in schemas.IDS if c in enriched.columns], *[number(f) for f in features]
    )


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Fail at plan time, before any job, when a stage's input lacks a column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
