"""File streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, types as T

from tidewell.frame import col, dtype_of
from tidewell.session import is_single_file


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    format: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New files under a path as a stream; `path` may also name a single file."""
    reader = spark.readStream.format(format).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if is_single_file(spark, path):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Makes a column usable for a watermark: without-zone timestamps are read as UTC."""
    if isinstance(dtype_of(df, column), T.TimestampNTZType):
        return df.withColumn(column, col(column).cast(T.TimestampType()))
    return df
