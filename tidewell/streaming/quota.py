"""Quota admission over a stream of hits, with one keyed state for each user."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator
from datetime import timedelta
from itertools import chain, islice
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.frame import col
from tidewell.operators.quota import DEFAULT_WINDOW, admit, microseconds
from tidewell.streaming.sinks import drain_append
from tidewell.streaming.source import event_time

_OUT = "user_key string, id long, at long, quota long, allowed boolean, used long, retry_after double"
_PACKED = (
    "user_key string, quota long, id array<long>, at array<long>, allowed array<boolean>, used array<long>, retry_after array<double>"
)
_DECIDED = Row("user_key", "quota", "id", "at", "allowed", "used", "retry_after")
# Decisions in one packed row; hits without an id are the last of their moment.
STRETCH, LAST = 10_000, (1 << 63) - 1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Unlimited users have no state; each one's hits spread over so many keys.
SPREAD = 64
DEFAULT_LATENESS = "1 day"


class Admission(StatefulProcessor):
    """One user's window: a list state with the moments of the hits allowed in the last window, at most `quota`.

    A timer at the end of the newest one's window clears the state of a user who stays away. Most users have few hits in a batch,
    so what counts is the work for each user: hits come as rows, and their decisions leave as arrays of up to `STRETCH` hits.
    """

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(rows)
        user, quota, rows = key[0], first.quota, chain([first], rows)
        if quota <= 0:
            while part := [(row.id, row.at) for row in islice(rows, STRETCH)]:
                ids, at = zip(*part)
                yield _DECIDED(user, quota, list(ids), list(at), [True] * len(ids), [0] * len(ids), [np.nan] * len(ids))
            return
        ids, moments = [], array("q")
        for row in rows:
            ids.append(row.id)
            moments.append(row.at)
        at = np.frombuffer(moments, dtype=np.int64)
        before = [row[0] for row in self.taken.get()]
        live = deque(before)
        if live:
            at = np.maximum(at, live[-1])
        order = np.lexsort(([LAST if i is None else i for i in ids], at))
        at = at[order]
        allowed, used, retry = admit(at, quota, live, self.length)
        if allowed.any():
            self.taken.put([(int(moment),) for moment in live])
            if before:
                self.handle.deleteTimer(self._end(before[-1]))
            self.handle.registerTimer(self._end(live[-1]))
        for a in range(0, len(ids), STRETCH):
            part = slice(a, a + STRETCH)
            yield _DECIDED(user, quota, [ids[i] for i in order[part].tolist()], at[part], allowed[part], used[part], retry[part])

    def _end(self, moment: int) -> int:
        """The first whole millisecond at which nothing counts a hit of that moment any more."""
        return -(-(moment + self.length) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


class QuotaStream:
    """Decides the hits of a stream, each batch with what the batches before it allowed.

    State is kept by user on the RocksDB provider below the query's checkpoint: a batch reads and writes the state of its own users only,
    and is scanned once. A user without a hit for a window and `lateness` has no state. A hit later than `lateness` behind the newest
    one is dropped, as the watermark says. A user's clock never runs back: a hit older than the last one
    allowed in an earlier batch counts as coming at that moment. The hits of one user in one batch are sorted in one task;
    the files of a trigger bound them.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        quotas: DataFrame,
        user: str = "user_id",
        ts: str = "ts",
        order: str = "event_id",
        window: timedelta = DEFAULT_WINDOW,
        lateness: str = DEFAULT_LATENESS,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.user, self.ts, self.order = user, ts, order
        self.window, self.lateness = window, lateness
        self.quotas = quotas.select(col(user).cast("string").alias("__user"), F.col("quota").cast("long").alias("__quota"))

    def decide(self, hits: DataFrame) -> DataFrame:
        """The stream of decisions: `user_key, id, at, quota, allowed, used, retry_after`.

        Users without a quota, or with one <= 0, are unlimited: `used` is 0.
        """
        timed = event_time(hits, self.ts).withWatermark(self.ts, self.lateness)
        quota = F.greatest(F.coalesce("__quota", F.lit(0)), F.lit(0)).cast("long")
        keyed = timed.select(
            col(self.user).cast("string").alias("user_key"), col(self.order).cast("long").alias("id"),
            F.unix_micros(col(self.ts)).alias("at"), col(self.ts).alias("moment"),
        ).join(self.quotas, F.col("user_key") == F.col("__user"), "left")
        keyed = keyed.select("user_key", "id", "at", "moment", quota.alias("quota")).withColumn(
            "part", F.when(F.col("quota") > 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(SPREAD))).cast("int")
        )
        packed = keyed.groupBy("user_key", "part").transformWithState(
            Admission(microseconds(self.window)), _PACKED, "append", "eventTime"
        )
        hits = packed.select("user_key", "quota", F.inline(F.arrays_zip("id", "at", "allowed", "used", "retry_after")))
        retry = F.when(~F.col("allowed"), F.col("retry_after")).alias("retry_after")
        return hits.select("user_key", "id", "at", "quota", "allowed", "used", retry)

    def drain(self, hits: DataFrame) -> DataFrame:
        """Decide all hits there are now; returns every decision so far."""
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, ROCKSDB)
        try:
            return drain_append(self.decide(hits), f"{self.folder}/decisions", f"{self.folder}/checkpoint")
        finally:
            if before is None:
                self.spark.conf.unset(_PROVIDER)
            else:
                self.spark.conf.set(_PROVIDER, before)

    def decisions(self) -> DataFrame:
        return self.spark.read.schema(_OUT).parquet(f"{self.folder}/decisions")
