"""Log analytics and quota admission against plain Python."""

import random
import time
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tidewell.operators.history import (
    due_rows, duration_buckets, kpi_delta, latest_state, multi_search, over_quota, recent_n, role_quotas, skip_buckets,
    status_counts, text_search, trailing_usage, trips_by_type, with_delta,
)
from tidewell.operators.quota import admit, quota_admission, segmented
from tidewell.session import scratch_dir
from tidewell.streaming import QuotaStream, stream_files
from tidewell.streaming.quota import STRETCH, Admission

START = datetime(2024, 3, 1)


def make_hits(seed, users=4, n=600, minutes=400, whole_minutes=True):
    """Hits of a few users, one of them with most rows; many share a moment."""
    rng = random.Random(seed)
    hits = []
    for i in range(n):
        user = None if rng.random() < 0.02 else ("hot" if rng.random() < 0.5 else f"u{rng.randrange(users)}")
        step = rng.randrange(minutes) if whole_minutes else rng.random() * minutes
        hits.append((i, user, START + timedelta(minutes=step)))
    return hits


QUOTAS = {"hot": 9, "u0": 1, "u1": 3, "u2": 0}


def brute_force(hits, quotas, window=timedelta(hours=1)):
    out, live = {}, {}
    for event, user, ts in sorted(hits, key=lambda h: (h[2], h[0])):
        quota = quotas.get(user, 0)
        if quota <= 0:
            out[event] = (True, 0, None)
            continue
        taken = live.setdefault(user, deque())
        while taken and taken[0] <= ts - window:
            taken.popleft()
        if len(taken) < quota:
            taken.append(ts)
            out[event] = (True, len(taken), None)
        else:
            out[event] = (False, len(taken), max((taken[0] + window - ts).total_seconds(), 1.0))
    return out


def frames(spark, hits, quotas=QUOTAS):
    return (
        spark.createDataFrame(hits, "event_id long, user_id string, ts timestamp_ntz"),
        spark.createDataFrame(list(quotas.items()), "user_id string, quota long"),
    )


def decisions(df, key="event_id"):
    return {
        r[key]: (r["allowed"], r["used"], None if r["retry_after"] is None else round(r["retry_after"], 6))
        for r in df.collect()
    }


def rounded(expected):
    return {k: (a, u, None if w is None else round(w, 6)) for k, (a, u, w) in expected.items()}


@pytest.mark.parametrize("seed, whole", [(1, True), (2, False), (3, True)])
def test_quota_small_users(spark, seed, whole):
    hits = make_hits(seed, whole_minutes=whole)
    assert decisions(quota_admission(*frames(spark, hits))) == rounded(brute_force(hits, QUOTAS))


@pytest.mark.parametrize("seed, whole", [(4, True), (5, False), (6, True), (7, False)])
def test_quota_in_small_batches(spark, conf, seed, whole):
    """A segment goes on from one Arrow batch to the next."""
    conf(spark__sql__execution__arrow__maxRecordsPerBatch="7")
    hits = make_hits(seed, whole_minutes=whole)
    assert decisions(quota_admission(*frames(spark, hits))) == rounded(brute_force(hits, QUOTAS))


def test_quota_segments(spark):
    """Gaps of exactly, almost and more than a window; before 1970 too."""
    hits = [(1000 * k + e, u, t + timedelta(hours=5 * k)) for k in range(4) for e, u, t in make_hits(8 + k, n=200, minutes=30 + 60 * k)]
    at = [datetime(1969, 12, 31, 22, 30), datetime(1969, 12, 31, 23, 30), datetime(1970, 1, 1, 0, 29, 59, 999_999), datetime(1970, 1, 1, 1, 29, 59, 999_999)]
    hits += [(9000 + i, "u0", t) for i, t in enumerate(at)]
    assert decisions(quota_admission(*frames(spark, hits))) == rounded(brute_force(hits, QUOTAS))
    df = spark.createDataFrame([("u0", i, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), 1) for i, t in enumerate(at)], "user_key string, id long, at long, quota long")
    found = [r["segment"] for r in segmented(df, 3_600_000_000).orderBy("id").collect()]
    assert found[0] != found[1] == found[2] != found[3]


def test_quota_segments_of_one_user_spread(spark, conf):
    """A user with a third of all hits is decided in many tasks, in one job whatever the time range."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="8")
    hours = [(i, "hot" if i % 3 == 0 else f"u{i % 40}", START + timedelta(hours=3 * (i // 30), seconds=i % 30)) for i in range(3000)]
    df, quotas = frames(spark, hours, {"hot": 4})
    decided = quota_admission(df, quotas)
    tasks = decided.where("user_id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 6
    assert decisions(decided) == rounded(brute_force(hours, {"hot": 4}))


def test_many_denied_hits_cost_no_loop():
    """Two million hits within an hour, three allowed."""
    at = np.arange(2_000_000) * 1000
    live = deque()
    started = time.perf_counter()
    allowed, used, retry = admit(at, 3, live, 3_600_000_000)
    assert time.perf_counter() - started < 2
    assert allowed.sum() == 3 and list(live) == [0, 1000, 2000] and used[-1] == 3 and retry[3] == 3599.997


def test_quota_keeps_key_types(spark):
    hits = spark.createDataFrame([(1, 7, START)], "event_id int, user_id int, ts timestamp")
    quotas = spark.createDataFrame([(7, 1)], "user_id int, quota int")
    out = quota_admission(hits, quotas)
    assert [t for _, t in out.dtypes] == ["int", "int", "timestamp", "boolean", "bigint", "bigint", "double"]


def drained(spark, hits, quotas, cuts, lateness="1 day", window=timedelta(hours=1)):
    """The stream's decisions when hits come in one file for each stretch of time up to a cut; and its checkpoint."""
    df, quotas = frames(spark, hits, quotas)
    folder = scratch_dir(spark, "t")
    stream = QuotaStream(spark, folder + "/state", quotas, lateness=lateness, window=window)
    low = START - timedelta(days=400)
    for high in [*cuts, START + timedelta(days=400)]:
        part = df.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        out = stream.drain(stream_files(spark, folder + "/in", df.schema))
        low = high
    return out, folder + "/state/checkpoint"


def test_quota_stream_equals_batch(spark):
    """Time-ordered files, one per batch: the stream decides as the batch does."""
    hits = sorted(make_hits(10), key=lambda h: (h[2], h[0]))
    # Batches must not share a moment: ids order the hits of one moment.
    cuts = [h[2] for h in hits[:: len(hits) // 4]][1:4]
    out, _ = drained(spark, hits, QUOTAS, cuts)
    assert decisions(out, "id") == rounded(brute_force(hits, QUOTAS))


def test_quota_stream_forgets_idle_users(spark):
    """Users who stay away for a window and the lateness leave no state; a late hit within it counts at its user's clock."""
    hits = [(i, f"u{i % 5}", START + timedelta(minutes=i)) for i in range(50)]
    hits += [(100 + i, "u0", START + timedelta(days=1, minutes=i)) for i in range(5)] + [(200, "u0", START + timedelta(days=2))]
    cuts = [START + timedelta(hours=12), START + timedelta(days=1, hours=12)]
    out, checkpoint = drained(spark, hits, {f"u{k}": 2 for k in range(5)}, cuts, lateness="10 minutes")
    assert decisions(out, "id") == rounded(brute_force(hits, {f"u{k}": 2 for k in range(5)}))
    state = spark.read.format("statestore").option("stateVarName", "taken").load(checkpoint)
    assert {r["key"]["user_key"] for r in state.select("key").collect()} == {"u0"}


def test_quota_stream_clock_does_not_run_back(spark):
    df, quotas = frames(spark, [(1, "a", START + timedelta(hours=2)), (2, "a", START + timedelta(hours=2))], {"a": 3})
    folder = scratch_dir(spark, "t")
    stream = QuotaStream(spark, folder + "/state", quotas)
    late = spark.createDataFrame([(3, "a", START), (4, "a", START), (5, None, START)], df.schema)
    for part in (df, late):
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        out = stream.drain(stream_files(spark, folder + "/in", df.schema))
    assert decisions(out, "id") == {1: (True, 1, None), 2: (True, 2, None), 3: (True, 3, None), 4: (False, 3, 3600.0), 5: (True, 0, None)}


class Handle:
    """Stands in for Spark's state: counts the calls, each of which crosses a socket."""

    def __init__(self):
        self.state, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.state)

    def put(self, rows):
        self.calls, self.state = self.calls + 1, list(rows)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


@pytest.mark.parametrize("n, quota", [(13, 2), (2 * STRETCH + 1, 3), (STRETCH + 1, 0)])
def test_quota_stream_work_for_a_user(n, quota):
    """A user's decisions leave in few packed rows; a batch asks the state at most four times for each user."""
    handle, work = Handle(), Admission(3_600_000_000)
    work.init(handle)
    hits = [(i, "u", START + timedelta(seconds=i)) for i in range(2 * n)]
    got = {}
    for batch in (hits[:n], hits[n:]):
        before = handle.calls
        rows = (Row(user_key="u", part=0, id=e, at=int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), moment=t, quota=quota) for e, _, t in reversed(batch))
        out = list(work.handleInputRows(("u", 0), rows, None))
        assert len(out) == -(-n // STRETCH) and handle.calls - before <= 4
        for r in out:
            got |= {e: (a, u, None if a else w) for e, a, u, w in zip(r.id, r.allowed, r.used, r.retry_after, strict=True)}
    assert got == brute_force(hits, {"u": quota}) and len(handle.timers) == (quota > 0)


def test_quota_stream_keeps_large_and_missing_ids(spark):
    """A missing id beside them leaves ids beyond 2^53 as they are."""
    hits = [(2**53 + 1, "u1", START), (2**53 + 3, "u2", START), (None, "u1", START)]
    out, _ = drained(spark, hits, QUOTAS, [])
    assert decisions(out, "id") == {2**53 + 1: (True, 1, None), 2**53 + 3: (True, 0, None), None: (True, 2, None)}


def test_trailing_usage(spark):
    hits = make_hits(11)
    df, _ = frames(spark, hits)
    for bucket in (timedelta(minutes=1), timedelta(minutes=7), timedelta(hours=30)):
        got = {r["event_id"]: r["used"] for r in trailing_usage(df, ["user_id"], "ts", bucket=bucket).collect()}
        want = {
            e: sum(1 for _, v, s in hits if v == u and t - timedelta(hours=1) < s <= t) for e, u, t in hits
        }
        assert got == want


def test_role_quotas_and_over_quota(spark):
    roles = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "none"), ("c", "off")], "user_id string, role string")
    quotas = spark.createDataFrame([("low", 1), ("high", 5), ("off", -1)], "role string, quota long")
    best = role_quotas(roles, quotas)
    assert {r["user_id"]: r["quota"] for r in best.collect()} == {"a": 5, "b": 0, "c": -1}
    usage = spark.createDataFrame([("a", 6), ("b", 99), ("c", 99), ("d", 99), ("a", 5)], "user_id string, used long")
    assert sorted((r["user_id"], r["over_quota"]) for r in over_quota(usage, best).collect()) == [
        ("a", False), ("a", True), ("b", False), ("c", False), ("d", False),
    ]


def test_latest_state_and_recent_n(spark):
    checks = spark.createDataFrame(
        [("x", 1, 1, "bad"), ("x", 2, 2, "good"), ("x", 2, 3, None), ("y", 1, 4, "bad")], "e string, t int, id int, s string"
    )
    assert {r["e"]: r["s"] for r in latest_state(checks, "e", ["t", "id"], ["s"]).collect()} == {"x": None, "y": "bad"}
    assert [(r["e"], r["id"], r["rank"]) for r in recent_n(checks, "e", ["t", "id"], 2).orderBy("e", "rank").collect()] == [
        ("x", 3, 1), ("x", 2, 2), ("y", 4, 1),
    ]


def test_skip_buckets(spark):
    now = datetime(2024, 3, 2)
    times = [now - timedelta(hours=24), now - timedelta(seconds=1), now, now - timedelta(hours=25), now - timedelta(hours=2)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r["n"] for r in skip_buckets(df, "t", now).orderBy("slot").collect()]
    assert got == [1] + [0] * 10 + [2]
    assert [r["n"] for r in skip_buckets(df.limit(0), "t", now).collect()] == [0] * 12


def test_trips_by_type(spark):
    log = spark.createDataFrame(
        [("guardrail.trip.max_rows", 5), ("guardrail.trip.max_rows", 1), ("guardrail.trip.quota", 5), ("guardrail.soft", 5)],
        "action string, created_at long",
    )
    assert [tuple(r) for r in trips_by_type(log, 2).collect()] == [("max_rows", 1), ("quota", 1)]


def test_kpi_delta(spark):
    pairs = [(0, 0), (5, 0), (10, 8), (8, 10), (3, 3), (1, 8), (0, 4)]
    df = spark.createDataFrame(pairs, "now long, then long")
    got = [(r["pct"], r["direction"], r["label"]) for r in with_delta(df, "now", "then").collect()]
    assert got == [
        (None, None, None), (100, "up", "+100%"), (25, "up", "+25%"), (-20, "down", "−20%"), (0, "flat", "0%"),
        (-87, "down", "−87%"), (-100, "down", "−100%"),
    ]
    values = spark.createDataFrame([(1, 2.0), (5, 3.0), (6, 1.5), (9, 100.0)], "t long, v double")
    row = kpi_delta(values, "t", 5, 0, 9, value="v").first()
    assert (row["current"], row["previous"]) == (4.5, 2.0)


def test_counts_and_buckets(spark):
    df = spark.createDataFrame([("ok", 0.04), ("ok", 0.05), ("ok", 500.0), ("bad", 1.0)], "status string, s double")
    assert status_counts(df, {"good": "status = 'ok'"}).first().asDict() == {"total": 4, "good": 3}
    got = {(r["outcome"], r["le"]): r["n"] for r in duration_buckets(df, "s", "status").collect()}
    assert got["ok", 0.05] == 2 and got["ok", 120.0] == 2 and got["ok", None] == 3 and got["bad", 0.5] == 0


def test_searches(spark):
    df = spark.createDataFrame(
        [("Stripe", "Payments", "billing", "rest"), ("GitHub", "Dev", "code", "graphql"), ("Pay%", "payments", None, "rest")],
        "name string, category string, description string, type string",
    )

    def names(**options):
        return sorted(r["name"] for r in text_search(df, **options).collect())

    assert names(query=" BILL ") == ["Stripe"] and names(query="%") == ["Pay%"] and len(names()) == 3
    assert names(equal_fold={"category": "PAYMENTS"}) == ["Pay%", "Stripe"]
    assert names(exact={"type": "REST"}) == [] and names(exact={"type": ""}) == names()
    ids = df.withColumn("id", F.monotonically_increasing_id())
    found = multi_search({"connection": (ids, "id", "name"), "workflow": (ids, "id", "category")}, "PAY", 3)
    assert [(r["type"], r["name"]) for r in found.collect()] == [
        ("connection", "Pay%"), ("workflow", "Payments"), ("workflow", "payments"),
    ]
    assert multi_search({"connection": (ids, "id", "name")}, "connect").count() == 3


def test_due_rows(spark):
    df = spark.createDataFrame([(True, 1), (False, 1), (True, 9), (True, None)], "schedule_enabled boolean, schedule_next_run long")
    assert due_rows(df, 5).count() == 1
