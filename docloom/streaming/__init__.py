"""The operators on streams: they are row expressions, so they work unchanged and keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.validate import Validator


def read_folder(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder, and those that come, as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def validate_stream(stream: DataFrame, validator: Validator, column: str | None, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Verdicts of a stream's rows appended to a folder, exactly once per row."""
    writer = validator.validate(stream, column).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
