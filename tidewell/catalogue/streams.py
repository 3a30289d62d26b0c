"""Streams, drained to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalogue.history import ORACLE as HISTORY_ORACLE
from tidewell.catalogue.inputs import ROLES, derived, role_quota_table, table
from tidewell.operators import filter_rows, join, transform
from tidewell.operators.history import role_quotas
from tidewell.plans import drain_flow
from tidewell.session import scratch_dir
from tidewell.streaming import (
    QuotaStream, drain_append, drain_batches, drain_updates, event_time, latest_state_stream, stream_files,
    windowed_counts,
)


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return stream_files(spark, f"{d.rstrip('/')}/events.parquet", schema)


# A week's events come as one file; with late ones every fiftieth event comes two weeks late.
_WEEK = "CAST(floor((extract(DAY FROM ts) - 1) / 7) AS INT)"
_ARRIVAL = f"{_WEEK} + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END"


def _weekly(spark, d, late):
    """The events as a stream of one file for each trigger."""
    folder = f"{scratch_dir(spark, 'weeks')}/in"
    events = table(spark, d, "events")
    arrival = F.expr(_ARRIVAL if late else _WEEK)
    for week in range(7 if late else 5):  # the stream takes files in the order in which they were written
        events.where(arrival == week).repartition(1).write.mode("append").parquet(folder)  # read by many tasks, written by one
    return stream_files(spark, folder, events.schema, max_files_per_trigger=1)


def _st_batches(spark, d):
    folder = scratch_dir(spark, "stream")
    return drain_batches(_weekly(spark, d, late=True), f"{folder}/out", f"{folder}/checkpoint")


def _st_incremental(spark, d):
    """The same flow twice over a growing folder: the second run sees only the new files."""
    folder = scratch_dir(spark, "stream")
    events = table(spark, d, "events")
    middle = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")

    def run():
        stream = stream_files(spark, f"{folder}/in", events.schema)
        shaped = transform(
            filter_rows(stream, "value > 5"), {"event_id": "event_id", "kind": "upper(event_type)", "cents": "round(value * 100)"}
        )
        return drain_append(shaped, f"{folder}/out", f"{folder}/checkpoint")

    events.where(F.col("ts") < middle).write.parquet(f"{folder}/in")
    run()
    events.where(F.col("ts") >= middle).write.mode("append").parquet(f"{folder}/in")
    return run()


def _st_stateless_join(spark, d):
    folder = scratch_dir(spark, "stream")
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = join(filter_rows(_events(spark, d), "event_type = 'purchase'"), customers, "user_id", "c_custkey", "left")
    return drain_append(joined.select("event_id", "user_id", "value", "c_name", "c_mktsegment"), f"{folder}/out", f"{folder}/checkpoint")


def _st_windowed_counts(spark, d):
    folder = scratch_dir(spark, "stream")
    counts = windowed_counts(event_time(_weekly(spark, d, late=True), "ts"), "ts", ["event_type"], "1 hour", delay="2 hours")
    out = drain_updates(counts, ["window_start", "window_end", "event_type"], f"{folder}/out", f"{folder}/checkpoint")
    return _zoneless(out)


def _st_sliding_counts(spark, d):
    folder = scratch_dir(spark, "stream")
    counts = windowed_counts(event_time(_weekly(spark, d, late=True), "ts"), "ts", [], "6 hours", "2 hours", "1 hour")
    out = drain_updates(counts, ["window_start", "window_end"], f"{folder}/out", f"{folder}/checkpoint")
    return _zoneless(out)


def _zoneless(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _st_latest_state(spark, d):
    folder = scratch_dir(spark, "stream")
    latest = latest_state_stream(_weekly(spark, d, late=True), "user_id", ["ts", "event_id"], ["event_type", "value", "ts"])
    return drain_updates(latest, ["user_id"], f"{folder}/out", f"{folder}/checkpoint")


def _st_quota(spark, d):
    folder = scratch_dir(spark, "quota-stream")
    quotas = role_quotas(derived(spark, d, ROLES), role_quota_table(spark))
    quotas.write.parquet(f"{folder}/quotas")  # once, not in every batch
    stream = QuotaStream(spark, folder, spark.read.schema(quotas.schema).parquet(f"{folder}/quotas"))
    decided = stream.drain(_weekly(spark, d, late=False))
    return decided.select(
        F.col("id").alias("event_id"), F.col("user_key").cast("long").alias("user_id"), "allowed", "used",
        F.round("retry_after", 3).alias("retry_after"),
    )


def _flow_node(node_id, kind, **config):
    return {"id": node_id, "type": kind, "name": node_id, "config": config}


# A stream, filtered and joined with a table; its rows go out as they are, and summed up by segment with the good segments told apart.
STREAM_FLOW = {
    "nodes": [
        _flow_node("events", "source", table="events", watermark={"column": "ts", "delay": "1 day"}),
        _flow_node("customers", "source", table="customer"),
        _flow_node("sold", "filter", expression="event_type IN ('purchase', 'signup') AND value > 2"),
        _flow_node("named", "join", leftKey="user_id", rightKey="c_custkey", type="left"),
        _flow_node("shape", "transform", columns={
            "event_id": "event_id", "kind": "event_type", "segment": "coalesce(c_mktsegment, 'none')", "cents": "CAST(round(value * 100) AS BIGINT)",
        }),
        _flow_node("rows", "output"),
        _flow_node("by_segment", "aggregate", groupBy=["segment", "kind"], aggregations=[
            {"op": "sum", "field": "cents", "as": "cents"}, {"op": "count", "as": "n"}, {"op": "max", "field": "cents", "as": "most"},
        ]),
        _flow_node("sums", "output"),
        _flow_node("large", "filter", expression="n > 20"),
        _flow_node("by_kind", "aggregate", groupBy=["kind"], aggregations=[{"op": "sum", "field": "n", "as": "n"}]),
        _flow_node("kinds", "output"),
    ],
    "edges": [
        {"id": f"{a}-{b}", "source": a, "target": b, "targetHandle": h}
        for a, b, h in (
            ("events", "sold", ""), ("sold", "named", "left"), ("customers", "named", "right"), ("named", "shape", ""), ("shape", "rows", ""),
            ("shape", "by_segment", ""), ("by_segment", "sums", ""), ("by_segment", "large", ""), ("large", "by_kind", ""), ("by_kind", "kinds", ""),
        )
    ],
}


def _st_flow(spark, d):
    """A flow over five weekly batches: three outputs, two of them behind a stateful aggregate."""
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    tables = {"events": _weekly(spark, d, late=False), "customer": customers}
    frames = drain_flow(spark, STREAM_FLOW, tables, scratch_dir(spark, "flow")).frames
    rows = frames["rows"].df.select(F.lit("rows").alias("output"), F.col("event_id").cast("string").alias("name"), "segment", "cents", F.lit(1).cast("long").alias("n"))
    sums = frames["sums"].df.select(F.lit("sums"), "kind", "segment", F.col("cents").cast("long"), "n")
    kinds = frames["kinds"].df.select(F.lit("kinds"), "kind", F.lit(None).cast("string"), F.lit(None).cast("long"), F.col("n").cast("long"))
    return rows.unionAll(sums).unionAll(kinds)


QUERIES = {
    "st_flow": _st_flow,
    "st_batches": _st_batches,
    "st_incremental": _st_incremental,
    "st_stateless_join": _st_stateless_join,
    "st_windowed_counts": _st_windowed_counts,
    "st_sliding_counts": _st_sliding_counts,
    "st_latest_state": _st_latest_state,
    "st_quota": _st_quota,
}

# Events with what the watermark is taken from when they come. A batch drops as late what the batch before it evicted,
# so that is the latest moment up to two batches before.
_MARKED = f"""
    SELECT e.*, w.mark FROM (SELECT *, {_ARRIVAL} AS arrival FROM events) e JOIN (
        SELECT arrival, max(latest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS mark
        FROM (SELECT {_ARRIVAL} AS arrival, max(ts) AS latest FROM events GROUP BY 1)) w USING (arrival)"""

_SHAPE = """SELECT event_id, event_type AS kind, coalesce(c_mktsegment, 'none') AS segment, CAST(round(value * 100) AS BIGINT) AS cents
        FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('purchase', 'signup') AND value > 2"""
_SUMS = f"SELECT kind, segment, sum(cents) AS cents, count(*) AS n FROM ({_SHAPE}) GROUP BY 1, 2"

ORACLE = {
    "st_flow": f"""
        SELECT 'rows' AS output, CAST(event_id AS VARCHAR) AS name, segment, cents, 1 AS n FROM ({_SHAPE})
        UNION ALL SELECT 'sums', kind, segment, cents, n FROM ({_SUMS})
        UNION ALL SELECT 'kinds', kind, NULL, NULL, sum(n) FROM ({_SUMS}) WHERE n > 20 GROUP BY kind""",
    "st_batches": f"SELECT *, {_ARRIVAL} AS batch FROM events",
    "st_incremental": """
        SELECT event_id, upper(event_type) AS kind, round(value * 100) AS cents FROM events WHERE value > 5""",
    "st_stateless_join": """
        SELECT event_id, user_id, value, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey
        WHERE event_type = 'purchase'""",
    "st_windowed_counts": f"""
        SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
               count(*) AS n FROM ({_MARKED})
        WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark - INTERVAL 2 HOUR GROUP BY 1, 2, 3""",
    "st_sliding_counts": f"""
        SELECT s AS window_start, s + INTERVAL 6 HOUR AS window_end, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 2 HOUR AS s
                     , mark
              FROM ({_MARKED}), range(0, 3) t(i))
        WHERE mark IS NULL OR s + INTERVAL 6 HOUR > mark - INTERVAL 1 HOUR GROUP BY 1""",
    "st_latest_state": """
        SELECT user_id, event_type, value, ts FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1""",
    "st_quota": f"SELECT event_id, user_id, allowed, used, retry_after FROM ({HISTORY_ORACLE['quota_admission']})",
}
