"""Raw CSV and JSON tables with every cell checked, so that nothing that does not parse becomes a null unseen.

A cell is rejected if it has text that its column's type cannot take; an empty cell is a null and is sound. A line
that has more or fewer cells than the schema, or is no JSON object, is rejected whole, because its cells cannot be told
apart: its columns are null. A CSV header with other names or another order is an error. Everything is one scan in
generated code; the rows are written once and both parts are read from that table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

LINE, REJECTED, SOUND = "_line", "rejected", "is_sound"
TIME = "yyyy-MM-dd HH:mm:ss"


class Checked(NamedTuple):
    """Rows without a rejected cell, the other rows with what was rejected, and how many there are of each."""

    sound: DataFrame
    rejected: DataFrame
    n_sound: int
    n_rejected: int


def _typed(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return cell
    if isinstance(field.dataType, T.TimestampType):
        return F.try_to_timestamp(cell, F.lit(TIME))
    return cell.try_cast(field.dataType)


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """The schema's columns and ``rejected``, an array of (cell, value): a column's name and the text found there, or
    null and the whole line. Sound rows have an empty array."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"{fmt} has typed columns; only csv and json are checked cell by cell")
    if taken := {LINE, REJECTED, SOUND} & {n.lower() for n in schema.names}:
        raise ValueError(f"the schema may not have the columns {', '.join(sorted(taken))}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.names, LINE]])
    reader = spark.read.schema(text).options(mode="PERMISSIVE", columnNameOfCorruptRecord=LINE)
    if fmt == "csv":
        reader = reader.options(header=True, enforceSchema=False, nullValue="", emptyValue="")
    whole = F.col(LINE).isNull()

    def found(cell: Column, value: Column) -> Column:
        return F.struct(cell.cast("string").alias("cell"), value.alias("value"))

    entries = [F.when(~whole, found(F.lit(None), F.col(LINE)))]
    for field in schema:
        text_of = F.col(f"`{field.name}`")
        bad = whole & text_of.isNotNull() & _typed(field).isNull()
        if not isinstance(field.dataType, T.StringType):
            entries.append(F.when(bad, found(F.lit(field.name), text_of)))
    return reader.format(fmt).load(path).select(
        *[F.when(whole, _typed(f)).alias(f.name) for f in schema], F.array_compact(F.array(*entries)).alias(REJECTED)
    )


def split_checked(checked: DataFrame, path: str) -> Checked:
    """Writes what ``read_checked`` gave to ``path``, sound and rejected rows apart, and reads both back."""
    marked = checked.withColumn(SOUND, F.size(REJECTED) == 0)
    marked.write.partitionBy(SOUND).parquet(path)
    stored = checked.sparkSession.read.schema(marked.schema).parquet(path)
    counts = {r[SOUND]: r["n"] for r in stored.groupBy(SOUND).agg(F.count("*").alias("n")).collect()}
    return Checked(
        stored.where(F.col(SOUND)).drop(REJECTED, SOUND),
        stored.where(~F.col(SOUND)).drop(SOUND),
        counts.get(True, 0),
        counts.get(False, 0),
    )
