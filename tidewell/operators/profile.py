"""Column profiles: summaries, distinct counts, histograms, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewell.frame import col, dtype_of, is_numeric, logical_type, numeric_columns, require, string_columns
from tidewell.session import scratch_dir

# Dictionary threshold, distinct-count cap, histogram buckets.
DICTIONARY_THRESHOLD = 128
DISTINCT_CAP = 10_000
HISTOGRAM_BUCKETS = 10

_DICTIONARY = "name string, value string, code long"


def describe(df: DataFrame) -> DataFrame:
    """One row per column, in one pass over the table.

    `name, type, count, null_count`, for numbers `min, max, mean` (which ignore NaN), for text
    `min_len, max_len` in bytes.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema):
        c = col(field.name)
        low = high = mean = F.lit(None).cast("double")
        short = long = F.lit(None).cast("long")
        aggregates.append(F.count(c).alias(f"n{i}"))
        if is_numeric(field.dataType):
            number = c.cast("double")
            number = F.when(~F.isnan(number), number)
            aggregates += [
                F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"avg{i}"),
            ]
            low, high, mean = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"avg{i}")
        elif isinstance(field.dataType, T.StringType):
            size = F.octet_length(c).cast("long")
            aggregates += [F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
            short, long = F.col(f"lo{i}"), F.col(f"hi{i}")
        rows.append(
            F.struct(
                F.lit(field.name).alias("name"), F.lit(logical_type(field.dataType)).alias("type"),
                F.col(f"n{i}").alias("count"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                low.alias("min"), high.alias("max"), mean.alias("mean"),
                short.alias("min_len"), long.alias("max_len"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _small_columns(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, bool]:
    """Which columns may have at most `limit` distinct values.

    One pass of small sketches, one row back. Twice the limit is twenty times
    the sketch's error away, so no column at the limit is missed.
    """
    row = df.agg(*[F.approx_count_distinct(_comparable(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] <= 2 * limit + 16 for i, c in enumerate(columns)}


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as values that can be counted: VARIANT as JSON text."""
    return F.to_json(col(name)) if isinstance(dtype_of(df, name), T.VariantType) else col(name)


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`name, value` of every distinct non-null value, as text."""
    pairs = [F.struct(F.lit(c).alias("name"), _comparable(df, c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL").distinct()


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, cap: int = DISTINCT_CAP, exact: bool = True
) -> DataFrame:
    """`name, distinct, capped` per column, counted up to `cap`; a `capped` number is a lower bound.

    Exact counts shuffle only columns that may lie below the cap; a column
    clearly above it is not read a second time.
    """
    names = list(columns) if columns is not None else df.columns
    require(df, *names)
    if not exact:
        sketches = [F.approx_count_distinct(_comparable(df, c)).alias(f"c{i}") for i, c in enumerate(names)]
        rows = [
            F.struct(
                F.lit(c).alias("name"), F.least(F.col(f"c{i}"), F.lit(cap).cast("long")).alias("distinct"),
                (F.col(f"c{i}") > cap).alias("capped"),
            )
            for i, c in enumerate(names)
        ]
        return df.agg(*sketches).select(F.inline(F.array(*rows)))

    small = _small_columns(df, names, cap)
    below = [c for c in names if small[c]]
    listed = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("name"), F.lit(0 if small[c] else cap + 1).cast("long").alias("n"))
                for c in names
            ]
        )
    )
    every = df.sparkSession.range(1).select(listed)
    if below:
        counted = _distinct_values(df, below).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        every = every.unionAll(counted)
    most = F.max("n")
    return every.groupBy("name").agg(F.least(most, F.lit(cap).cast("long")).alias("distinct"), (most > cap).alias("capped"))


def low_cardinality(
    df: DataFrame, threshold: int = DICTIONARY_THRESHOLD, columns: Sequence[str] | None = None
) -> DataFrame:
    """`name, distinct` of the text columns with 1 to `threshold` distinct values."""
    names = list(columns) if columns is not None else string_columns(df)
    require(df, *names)
    small = _small_columns(df, names, threshold) if names and threshold > 0 else {}
    below = [c for c in names if small.get(c)]
    if not below:
        return df.sparkSession.createDataFrame([], "name string, distinct long")
    counted = _distinct_values(df, below).groupBy("name").agg(F.count(F.lit(1)).alias("distinct"))
    return counted.where(F.col("distinct") <= threshold)


def dictionaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`name, value, code` per distinct value; codes count from 0 in value order."""
    order = Window.partitionBy("name").orderBy("value")
    return _distinct_values(df, columns).select(
        "name", "value", (F.row_number().over(order) - 1).cast("long").alias("code")
    )


def dictionary_encode(df: DataFrame, threshold: int = DICTIONARY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(table with text columns of few values replaced by codes, their dictionaries).

    Null stays null. The dictionaries are written to the scratch folder, so they
    are built once and Spark knows their size when it picks the join.
    """
    spark = df.sparkSession
    chosen = sorted(r["name"] for r in low_cardinality(df, threshold).collect())
    if not chosen:
        return df, spark.createDataFrame([], _DICTIONARY)
    path = scratch_dir(spark, "dictionary") + "/entries"
    dictionaries(df, chosen).write.parquet(path)
    table = spark.read.schema(_DICTIONARY).parquet(path)
    # Few values a column, so all dictionaries are one small row: a scalar subquery, looked up without a join.
    maps = table.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))).alias("codes"))
    every = maps.agg(F.map_from_entries(F.collect_list(F.struct("name", "codes"))).alias("maps")).scalar()
    held = "__maps"
    while held in df.columns:
        held = f"_{held}"
    out = df.withColumn(held, every)
    codes = {n: F.try_element_at(F.col(held).getItem(n), col(n)) for n in chosen}
    return out.select(*[codes.get(c, col(c)).alias(c) for c in df.columns]), table


def histogram(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = HISTOGRAM_BUCKETS) -> DataFrame:
    """`name, bucket (1..), low, high, n, nulls` for numeric columns.

    Equal-width buckets between each column's bounds; the maximum belongs to the
    last one. The bounds are a scalar subquery, so nothing is joined. Values
    that are no finite number count as null.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    require(df, *names)
    if not names:
        raise ValueError("no numeric column to build a histogram of")

    def finite(name: str) -> Column:
        number = col(name).cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)

    bounds = df.agg(
        F.struct(
            *[F.min(finite(c)).alias(f"lo{i}") for i, c in enumerate(names)],
            *[F.max(finite(c)).alias(f"hi{i}") for i, c in enumerate(names)],
        ).alias("bounds")
    )
    limits = F.col("__limits")
    entries = []
    for i, c in enumerate(names):
        low, high, value = limits[f"lo{i}"], limits[f"hi{i}"], finite(c)
        share = F.floor((value - low) * buckets / (high - low)).cast("int") + 1
        bucket = F.when(value.isNotNull(), F.when(high > low, F.least(share, F.lit(buckets))).otherwise(1))
        entries.append(F.struct(F.lit(c).alias("name"), bucket.alias("bucket"), low.alias("lo"), high.alias("hi")))
    bounded = df.select(*[col(c) for c in names], bounds.scalar().alias("__limits"))
    counted = bounded.select(F.inline(F.array(*entries))).groupBy("name", "bucket", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most buckets + 1 rows per column are left here.
    per_column = counted.groupBy("name", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))).alias("hits"),
        F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("nulls"),
    )
    width = (F.col("hi") - F.col("lo")) / buckets
    return per_column.select(
        "name", "lo", "hi", "hits", "nulls", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("bucket")
    ).select(
        "name", "bucket", (F.col("lo") + (F.col("bucket") - 1) * width).alias("low"),
        (F.col("lo") + F.col("bucket") * width).alias("high"),
        F.coalesce(F.try_element_at("hits", F.col("bucket")), F.lit(0).cast("long")).alias("n"), "nulls",
    )
