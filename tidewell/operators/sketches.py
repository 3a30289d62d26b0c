"""Column profiles that merge: new data is profiled without reading old data again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.frame import col, is_numeric, logical_type

# Registers of a distinct sketch (2^LOG_K; its error is about 0.8 %) and the accuracy of a quantile sketch (about 1.3 % of ranks).
LOG_K, K = 14, 200
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
STATE = (
    "name string, type string, rows long, non_null long, low double, high double, total double, finite long, "
    "distinct binary, quantiles binary"
)


def profile_state(df: DataFrame) -> DataFrame:
    """One row per column that sums a table up: counts, bounds and sums exactly, distinct values and quantiles as sketches.

    One pass, one row of the size of the sketches for each task in the shuffle. Write it beside the data it describes.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    nothing = {c: F.lit(None).cast(t) for c, t in (("low", "double"), ("high", "double"), ("total", "double"), ("finite", "long"), ("quantiles", "binary"))}
    for i, field in enumerate(df.schema):
        c = col(field.name)
        countable = c.cast("string") if logical_type(field.dataType) != "json" else F.to_json(c)
        aggregates += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(countable, LOG_K).alias(f"d{i}")]
        own = dict(nothing)
        if is_numeric(field.dataType):
            number = c.cast("double")
            number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
            aggregates += [
                F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.sum(number).alias(f"s{i}"), F.count(number).alias(f"f{i}"),
                F.call_function("kll_sketch_agg_double", number, F.lit(K)).alias(f"q{i}"),
            ]
            own = {"low": F.col(f"lo{i}"), "high": F.col(f"hi{i}"), "total": F.col(f"s{i}"), "finite": F.col(f"f{i}"), "quantiles": F.col(f"q{i}")}
        rows.append(
            F.struct(
                F.lit(field.name).alias("name"), F.lit(logical_type(field.dataType)).alias("type"), F.col("rows"),
                F.col(f"n{i}").alias("non_null"), own["low"].alias("low"), own["high"].alias("high"), own["total"].alias("total"),
                own["finite"].alias("finite"), F.col(f"d{i}").alias("distinct"), own["quantiles"].alias("quantiles"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merge_states(*states: DataFrame) -> DataFrame:
    """States of several tables (or of several appends) as the state of all their rows; columns meet by name.

    A column that kinds of unlike type share has the type `json`, as in a union.
    """
    every = reduce(DataFrame.unionByName, states)
    total = every.groupBy("name").agg(
        F.min("type").alias("first_type"), F.max("type").alias("last_type"), F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("finite").alias("finite"),
        F.hll_union_agg("distinct").alias("distinct"), F.call_function("kll_merge_agg_double", F.col("quantiles")).alias("quantiles"),
        F.count("quantiles").alias("sketched"),
    )
    both = F.concat_ws(" ", "first_type", "last_type")
    kind = (
        F.when(F.col("first_type") == F.col("last_type"), F.col("first_type")).when(both == "float64 int64", "float64").otherwise("json")
    )
    return total.select(
        "name", kind.alias("type"), "rows", "non_null", "low", "high", "total", "finite", "distinct",
        F.when(F.col("sketched") > 0, F.col("quantiles")).alias("quantiles"),
    )


def profile_of(state: DataFrame) -> DataFrame:
    """`name, type, count, null_count, min, max, mean, distinct, q25, median, q75` of a state; `distinct` and quantiles are estimates."""

    def quantile(rank: float) -> Column:
        return F.when(F.col("finite") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("quantiles"), F.lit(rank)))

    return state.select(
        "name", "type", F.col("non_null").alias("count"), (F.col("rows") - F.col("non_null")).alias("null_count"),
        F.col("low").alias("min"), F.col("high").alias("max"), F.when(F.col("finite") > 0, F.col("total") / F.col("finite")).alias("mean"),
        F.hll_sketch_estimate("distinct").alias("distinct"), *[quantile(q).alias(n) for n, q in QUANTILES.items()],
    )
