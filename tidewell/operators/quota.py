"""Exact sliding-window quota admission.

A hit is allowed if fewer than `quota` *allowed* hits of the same user lie in
the window (ts - window, ts]; denied hits use nothing up. The decision about a
hit depends on all decisions before it, so no plain window function can give it.

What lies a whole window or more before a hit does not touch it. So a user's hits
fall into segments wherever a window passes without any, and segments are
decided independently of each other, in parallel and in one job. Within a segment hits come
sorted and in batches; all that is kept is the allowed hits of the last window.
While no place is free, the hits up to the next expiry are denied at one stroke,
so the loop runs over allowed hits, not over all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewell.frame import col, dtype_of, require

DEFAULT_WINDOW = timedelta(hours=1)
MIN_RETRY_SECONDS = 1.0

_DECISIONS = "id long, at long, quota long, allowed boolean, used long, retry_after double"


def quota_admission(
    hits: DataFrame,
    quotas: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    order: str = "event_id",
    quota: str = "quota",
    window: timedelta = DEFAULT_WINDOW,
) -> DataFrame:
    """Decide every hit: `<user>, <order>, <ts>, allowed, used, quota, retry_after` (seconds).

    `quotas` has one row per user; a user without quota, or with one <= 0, is
    unlimited. Hits of one user at one moment are taken in the order of the unique
    integer column `order`. Join on that column for the other columns of a hit.
    """
    require(hits, user, ts, order)
    none = F.lit(0).cast("long")
    limits = quotas.select(col(user).alias("__user"), col(quota).cast("long").alias("__quota"))
    joined = hits.select(
        col(user).alias("user_key"), col(order).cast("long").alias("id"),
        F.unix_micros(col(ts).cast("timestamp")).alias("at"),
    ).join(limits, F.col("user_key") == F.col("__user"), "left")
    limited = joined.where(F.col("__quota") > 0).select(
        "user_key", "id", "at", F.col("__quota").alias("quota")
    )
    free = joined.where(F.coalesce("__quota", none) <= 0).select(
        "user_key", "id", "at", none.alias("quota"), F.lit(True).alias("allowed"), none.alias("used"),
        F.lit(None).cast("double").alias("retry_after"),
    )
    moment = F.timestamp_micros("at").cast(dtype_of(hits, ts))
    return decide(limited, window).unionAll(free).select(
        F.col("user_key").alias(user), F.col("id").cast(dtype_of(hits, order)).alias(order), moment.alias(ts),
        "allowed", "used", "quota", "retry_after",
    )


def decide(hits: DataFrame, window: timedelta = DEFAULT_WINDOW) -> DataFrame:
    """Decisions about `user_key, id, at (microseconds), quota` rows."""
    length = microseconds(window)
    decisions = T.StructType([T.StructField("user_key", dtype_of(hits, "user_key")), *T.StructType.fromDDL(_DECISIONS)])
    order = Window.partitionBy("user_key", "segment").orderBy("at", "id")
    # Dealt out by segment, even where the hits come dealt out by user. The row number keeps a segment's rows together and in order.
    dealt = segmented(hits, length).repartition("user_key", "segment")
    ordered = dealt.withColumn("turn", F.row_number().over(order)).drop("segment")

    def run(batches):
        live: deque[int] = deque()
        for batch in batches:
            at = batch["at"].to_numpy()
            starts = np.flatnonzero(batch["turn"].to_numpy() == 1).tolist()
            cuts = sorted({0, *starts, len(batch)})
            begins = set(starts)
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if a in begins:
                    live = deque()
                parts.append(admit(at[a:b], int(batch["quota"].iat[a]), live, length))
            allowed, used, retry = (np.concatenate(p) for p in zip(*parts)) if parts else ([], [], [])
            yield batch[["user_key", "id", "at", "quota"]].assign(allowed=allowed, used=used, retry_after=retry)

    return ordered.mapInPandas(run, decisions)


def microseconds(window: timedelta) -> int:
    return window // timedelta(microseconds=1)


def segmented(hits: DataFrame, length: int) -> DataFrame:
    """Adds `segment`: hits of a user in different segments lie at least a window apart from each other.

    Two hits in one slice of time as long as the window are nearer than that, so segments begin at slices only, and a
    row for each user and slice tells where. A user's busy slices thus meet in one task, its hits do not.
    """
    slice_ = F.floor(F.col("at") / F.lit(length)).cast("long")
    sliced = hits.withColumn("slice", slice_)
    ends = sliced.groupBy("user_key", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    in_time = Window.partitionBy("user_key").orderBy("slice")
    apart = F.coalesce(F.col("first") - F.lag("last").over(in_time) >= length, F.lit(True))
    begun = ends.withColumn("apart", apart)
    segments = begun.select(
        F.col("user_key").alias("of"), F.col("slice").alias("in"),
        F.max(F.when(F.col("apart"), F.col("slice"))).over(in_time.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"),
    )
    same = F.col("user_key").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in"))
    return sliced.join(segments, same).drop("of", "in", "slice")


def admit(at: np.ndarray, quota: int, live: deque[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Allowed, used and retry-after (seconds) of one user's next hits in time order.

    `live` holds the moments of the hits allowed in the last window, oldest first, and is carried on.
    """
    times = at.tolist()
    count = len(times)
    allowed, used, retry = np.ones(count, dtype=bool), np.empty(count, dtype=np.int64), np.full(count, np.nan)
    now = 0
    while now < count:
        moment = times[now]
        while live and live[0] <= moment - length:
            live.popleft()
        if len(live) < quota:
            live.append(moment)
            used[now] = len(live)
            now += 1
            continue
        free = live[0] + length
        until = bisect_left(times, free, now)
        allowed[now:until] = False
        used[now:until] = len(live)
        retry[now:until] = np.maximum((free - at[now:until]) / 1_000_000, MIN_RETRY_SECONDS)
        now = until
    return allowed, used, retry
