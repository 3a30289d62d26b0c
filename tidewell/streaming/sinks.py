"""Run a stream over what is there now, then stop.

Each call continues where the last one with the same `checkpoint` ended.
Batches are written under their number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewell.frame import col
from tidewell.session import names, remove

# Batches of changes that may lie beside a base before they are merged into it.
BATCHES = 8


def drain_append(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append new rows to a Parquet folder; returns the whole folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """One output folder per batch, `batch=<n>`; returns all of them with the number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, checkpoint, write)
    return stream.sparkSession.read.option("basePath", path).parquet(path)


def drain_updates(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """The latest row per key of a stream in update mode.

    Every batch's changed rows are written apart; the newest batch of a key wins. Once more than `BATCHES`
    batches lie there, they and the base before them are merged into a new base, so a call reads
    the keys once and not all that ever changed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    run_batches(stream, checkpoint, write, "update")
    spark, schema = stream.sparkSession, T.StructType(list(stream.schema)).add("batch", T.IntegerType())
    base, batches = _parts(spark, path)
    if len(batches) > BATCHES:
        last = max(batches)
        merged = _newest(spark, path, schema, base, batches, keys)
        merged.write.mode("overwrite").parquet(f"{path}/base={last}")
        for old in [f"changes/batch={b}" for b in batches] + ([f"base={base}"] if base not in (None, last) else []):
            remove(spark, f"{path}/{old}")
        base, batches = last, []
    return _newest(spark, path, schema, base, batches, keys).drop("batch")


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The number of the newest base, and those of the batches after it."""
    bases = [int(n.removeprefix("base=")) for n in names(spark, path) if n.startswith("base=")]
    base = max(bases, default=None)
    batches = [int(n.removeprefix("batch=")) for n in names(spark, f"{path}/changes") if n.startswith("batch=")]
    return base, sorted(b for b in batches if base is None or b > base)


def _newest(spark: SparkSession, path: str, schema: T.StructType, base: int | None, batches: list[int], keys: Sequence[str]) -> DataFrame:
    """Each key's newest row with the number of its batch."""
    parts = [spark.read.schema(schema).parquet(f"{path}/base={base}")] if base is not None else []
    if batches:
        folders = [f"{path}/changes/batch={b}" for b in batches]
        parts.append(spark.read.schema(schema).option("basePath", f"{path}/changes").parquet(*folders))
    changed = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in keys]
    newest = F.max_by(F.struct(*[col(c) for c in rest]), F.col("batch")).alias("__row")
    return changed.groupBy(*[col(k) for k in keys]).agg(newest).where("__row IS NOT NULL").select(
        *[(col(c) if c in keys else F.col("__row").getField(c)).alias(c) for c in schema.names]
    )


def run_batches(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
