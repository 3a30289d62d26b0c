"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch stays small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, label)}/data"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*names: str) -> list[str]:
    """Column names that no caller uses."""
    return [f"__{n}_{uuid.uuid4().hex[:8]}" for n in names]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Add to each row, for each name, the sum of its column over all rows before it in `order`.

    Rows are dealt out by ranges of `order` and written once; totals of the ranges give each range its
    offset. No task sees more than its range, and the driver sees nothing. Rows with equal `order` may
    come in either order. Nothing in `df` may be called like the new columns.
    """
    spark = df.sparkSession
    part, row, *_ = fresh("part", "row")
    values = {n: f"{n}__value" for n in sums}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.withColumns({values[n]: c.cast("long") for n, c in sums.items()}).repartitionByRange(parts, *order)
    laid = materialise(laid.withColumn(part, F.spark_partition_id()), label)
    totals = laid.groupBy(part).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select(F.col(part), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}__before") for n in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    out = local.join(offsets, part)
    out = out.withColumns({n: F.col(n) + F.col(f"{n}__before") for n in sums})
    return out.drop(part, row, *values.values(), *[f"{n}__before" for n in sums])


def chunks(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]
