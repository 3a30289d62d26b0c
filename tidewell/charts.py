"""Chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewell.frame import col, dtype_of, is_numeric, require
from tidewell.functions.chart import ChartConfig, chart_number

# Rows shown by a chart and kept in a saved one; series per chart.
CHART_ROWS = 50
SNAPSHOT_ROWS = 200
MAX_SERIES = 3
KINDS = ("bar", "line", "area", "pie")


def chart_data(df: DataFrame, config: ChartConfig, order_by: Sequence[str], rows: int = CHART_ROWS) -> DataFrame:
    """The first rows in a given order: x as is, the y columns as numbers."""
    if config.kind not in KINDS:
        raise ValueError(f"unknown chart kind {config.kind!r}; known: {', '.join(KINDS)}")
    if not config.x or not config.y:
        raise ValueError("chart needs an x and a y column")
    series = config.y[: 1 if config.kind == "pie" else MAX_SERIES]
    require(df, config.x, *series, *order_by)
    first = df.orderBy(*[col(c) for c in order_by]).limit(rows)
    x = [] if config.x in series else [col(config.x)]
    return first.select(*x, *[chart_number(col(y), dtype_of(df, y)).alias(y) for y in series])


def _numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(dtype_of(df, name)):
            raise TypeError(f"column {name!r} is not numeric")


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Sum of `value` per (x, y) cell."""
    require(df, x, y, value)
    _numeric(df, value)
    return df.groupBy(col(x), col(y)).agg(F.sum(col(value).cast("double")).alias("value"))


def stacked_share(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """Each series' share of the total at its x (100% stack): `<x>, <series>, value, share`.

    The totals are joined back instead of taken over a window per x, which would
    put all series of one x into one task.
    """
    cells = heatmap(df, x, series, value)
    totals = cells.groupBy(col(x).alias("__x")).agg(F.sum("value").alias("__total"))
    joined = cells.join(totals, col(x).eqNullSafe(F.col("__x")))
    share = F.try_divide(F.col("value"), F.col("__total"))
    return joined.select(col(x), col(series), "value", share.alias("share"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None) -> DataFrame:
    """Points with both coordinates present."""
    extra = [c for c in (color, size) if c]
    require(df, x, y, *extra)
    points = df.select(
        chart_number(col(x), dtype_of(df, x)).alias("x"), chart_number(col(y), dtype_of(df, y)).alias("y"),
        *[col(c) for c in extra],
    )
    return points.where("x IS NOT NULL AND y IS NOT NULL")


def sparkline(df: DataFrame, key: str, ts: str, value: str, unit: str = "day") -> DataFrame:
    """One small series per key: sums per time unit, in time order.

    Values are summed per unit first, so a series is as long as the time range,
    however many rows a key has.
    """
    require(df, key, ts, value)
    _numeric(df, value)
    per_unit = df.groupBy(col(key), F.date_trunc(unit, col(ts)).alias("__unit")).agg(
        F.sum(col(value).cast("double")).alias("__sum")
    )
    series = F.array_sort(F.collect_list(F.struct("__unit", "__sum")))
    return per_unit.groupBy(col(key)).agg(
        F.transform(series, lambda p: p["__sum"]).alias("points"), F.count(F.lit(1)).alias("n")
    )


def downsample(df: DataFrame, ts: str, value: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """At most 2 x width points per series: the lowest and highest of each time bin.

    The time range is that of the whole table, taken as a scalar subquery.
    """
    require(df, ts, value, *keys)
    _numeric(df, value)
    if width < 1:
        raise ValueError("width must be at least 1")
    micros = F.unix_micros(col(ts).cast("timestamp"))
    present = df.where(col(value).isNotNull())
    limits = present.agg(F.struct(F.min(micros).alias("lo"), F.max(micros).alias("hi")).alias("range")).scalar()
    timed = present.select(
        *[col(k) for k in keys], col(ts).alias("ts"), col(value).cast("double").alias("value"),
        micros.alias("__at"), limits.alias("__range"),
    )
    span = F.col("__range.hi") - F.col("__range.lo") + 1
    scaled = (F.col("__at") - F.col("__range.lo")) * F.lit(width)
    bin_no = ((scaled - scaled % span) / span).cast("long")
    points = timed.select(*[col(k) for k in keys], bin_no.alias("bin"), "ts", "value")
    ends = points.groupBy(*[col(k) for k in keys], "bin").agg(
        F.min(F.struct("value", "ts")).alias("low"), F.max(F.struct("value", "ts")).alias("high")
    )
    return ends.select(
        *[col(k) for k in keys], "bin", F.explode(F.array_distinct(F.array("low", "high"))).alias("p")
    ).select(*[col(k) for k in keys], "bin", F.col("p.ts").alias("ts"), F.col("p.value").alias("value"))
