"""A fitted forest as three Parquet tables under one version folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wardline.operators.forest import NODES, Forest

SCALER = "position int, feature string, mean double, std double, n long"
META = "sample_size int, score_offset double, seed int"


def save_forest(model: Forest, path: str) -> None:
    """Writes a new version; an existing one is never touched."""
    spark = model.spark
    scaler = spark.createDataFrame([tuple(r) for r in model.scaler], SCALER)
    scaler.coalesce(1).write.parquet(f"{path}/scaler")
    spark.createDataFrame(model.nodes, NODES).coalesce(1).write.parquet(f"{path}/nodes")
    meta = spark.createDataFrame([(model.sample_size, model.offset, model.seed)], META)
    meta.coalesce(1).write.parquet(f"{path}/meta")


def load_forest(spark: SparkSession, path: str) -> Forest:
    scaler = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    meta = spark.read.parquet(f"{path}/meta").head()
    return Forest(
        spark,
        [r["feature"] for r in scaler],
        scaler,
        nodes,
        meta["sample_size"],
        meta["score_offset"],
        meta["seed"],
    )
