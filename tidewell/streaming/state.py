"""Stateful aggregates over streams. They take batch tables too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewell.frame import col, require
from tidewell.operators.history import latest_state


def windowed_counts(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    size: str = "1 hour",
    slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Rows per key and time window: `window_start, window_end, <keys>, n`.

    With a `delay` a row later than the watermark is dropped and old windows
    leave the state.
    """
    require(df, ts, *keys)
    timed = df.withWatermark(ts, delay) if delay else df
    window = F.window(col(ts), size, slide) if slide else F.window(col(ts), size)
    return timed.groupBy(window.alias("window"), *[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[col(k) for k in keys], "n",
    )


def latest_state_stream(df: DataFrame, entity: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Newest state per entity; the state holds one row per entity. For update mode."""
    return latest_state(df, entity, order, state)
