"""Documents from text and from typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_json(df: DataFrame, column: str, into: str = "doc", malformed: str = "malformed") -> DataFrame:
    """Parse a JSON text column to VARIANT; text that is no JSON gives an absent document and `malformed`."""
    return df.withColumn(into, F.try_parse_json(F.col(column))).withColumn(malformed, F.col(column).isNotNull() & F.col(into).isNull())


def read_json_lines(spark: SparkSession, path: str, into: str = "doc") -> DataFrame:
    """One JSON document a line."""
    return from_json(spark.read.text(path), "value", into)


def row_document(*columns: str) -> Column:
    """Typed columns as a VARIANT object; only those named are read. NULL cells become JSON null."""
    return F.to_variant_object(F.struct(*columns))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_json(df: DataFrame, column: str, path: str) -> None:
    """A VARIANT column as JSON lines."""
    df.select(F.to_json(F.col(column)).alias("value")).write.text(path)


def dealt(df: DataFrame, key: str, parts_a_core: int = 4) -> DataFrame:
    """The rows dealt by a key that few of them share, for a walk over single values, which costs far more than moving them.

    A file is read by no more tasks than it has row groups, however many cores there are. A table in so many parts that each
    core gets several stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= parts_a_core * cores else df.repartition(parts_a_core * cores, key)
