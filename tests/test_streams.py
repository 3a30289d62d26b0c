"""Streams against their batch twins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import filter_rows, join
from tidewell.plans import drain_flow, run_flow
from tidewell.session import scratch_dir
from tidewell.streaming import (
    drain_append, drain_batches, drain_updates, event_time, latest_state_stream, stream_files, windowed_counts,
)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return scratch_dir(spark, "t")


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_one_output_per_batch(spark, folder, events):
    events.repartition(4).write.parquet(folder + "/in")
    stream = stream_files(spark, folder + "/in", events.schema, max_files_per_trigger=1)
    out = drain_batches(stream, folder + "/out", folder + "/cp")
    assert out.select("batch").distinct().count() == 4
    assert same(out.drop("batch"), events)


def test_second_run_takes_only_new_files(spark, folder, events):
    middle = F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")

    def run():
        stream = stream_files(spark, folder + "/in", events.schema)
        return drain_append(filter_rows(stream, "value > 5"), folder + "/out", folder + "/cp", ["event_type"])

    events.where(F.col("ts") < middle).write.parquet(folder + "/in")
    first = run().count()
    assert run().count() == first
    events.where(F.col("ts") >= middle).write.mode("append").parquet(folder + "/in")
    assert same(run(), events.where("value > 5")) and first < events.where("value > 5").count()


def test_stream_static_join(spark, folder, events):
    names = spark.range(0, 2000, 2).select("id", F.concat(F.lit("u"), "id").alias("name"))
    stream = stream_files(spark, f"{SF_DIR}/events.parquet", events.schema)
    out = drain_append(join(stream, names, "user_id", "id", "left"), folder + "/out", folder + "/cp")
    assert same(out, join(events, names, "user_id", "id", "left"))


def test_windowed_counts_equal_batch_for_shuffled_files(spark, folder, events):
    # The delay exceeds the time range, so no row of the mixed files is late.
    events.repartition(5).write.parquet(folder + "/in")
    stream = event_time(stream_files(spark, folder + "/in", events.schema, max_files_per_trigger=1), "ts")
    counts = windowed_counts(stream, "ts", ["event_type"], "6 hours", "3 hours", delay="60 days")
    out = drain_updates(counts, ["window_start", "window_end", "event_type"], folder + "/out", folder + "/cp")
    assert same(out, windowed_counts(event_time(events, "ts"), "ts", ["event_type"], "6 hours", "3 hours"))


def test_late_rows_are_dropped(spark, folder):
    def hits(*hours):
        return spark.createDataFrame([(datetime(2024, 1, 1, h, 30),) for h in hours], "ts timestamp")

    def run():
        stream = stream_files(spark, folder + "/in", "ts timestamp")
        counts = windowed_counts(stream, "ts", [], "1 hour", delay="1 hour")
        return drain_updates(counts, ["window_start", "window_end"], folder + "/out", folder + "/cp")

    hits(1, 10).write.parquet(folder + "/in")
    run()
    # The watermark is now 09:30: the second row is too late, the third is not.
    hits(11, 1, 9).write.mode("append").parquet(folder + "/in")
    got = {r["window_start"].hour: r["n"] for r in run().collect()}
    assert got == {1: 1, 10: 1, 11: 1, 9: 1}


def test_latest_state_equals_batch(spark, folder, events):
    events.repartition(3).write.parquet(folder + "/in")
    stream = stream_files(spark, folder + "/in", events.schema, max_files_per_trigger=1)
    args = ("user_id", ["ts", "event_id"], ["event_type", "value"])
    out = drain_updates(latest_state_stream(stream, *args), ["user_id"], folder + "/out", folder + "/cp")
    assert same(out, latest_state_stream(events, *args))


def test_scratch_folder_follows_the_cluster_setting(spark, tmp_path, monkeypatch):
    """A folder of its own each time, below the setting, and always with its file system: a bare path is somebody else's disk."""
    from pyarrow import fs

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else default[0])
    path = scratch_dir(spark, "t")
    assert path != scratch_dir(spark, "t") and path.startswith(f"file://{tmp_path}/")
    assert isinstance(fs.FileSystem.from_uri(path)[0], fs.LocalFileSystem)


def test_batches_of_changes_are_merged(spark, folder, monkeypatch):
    from tidewell.session import names
    from tidewell.streaming import sinks

    monkeypatch.setattr(sinks, "BATCHES", 2)
    rows = [(k, i) for i in range(5) for k in range(3) if (k + i) % 2]
    for i in range(5):
        part = spark.createDataFrame([r for r in rows if r[1] == i], "k int, at int")
        part.coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = stream_files(spark, folder + "/in", "k int, at int", max_files_per_trigger=1)
        latest = latest_state_stream(stream, "k", ["at"], ["at"])
        got = drain_updates(latest, ["k"], folder + "/out", folder + "/cp").collect()
        want = {k: max(a for x, a in rows if x == k and a <= i) for k in {x for x, a in rows if a <= i}}
        assert {r["k"]: r["at"] for r in got} == want
    assert len(names(spark, folder + "/out/changes")) <= 2 and any(n.startswith("base=") for n in names(spark, folder + "/out"))


def flow_parts():
    def node(i, kind, **config):
        return {"id": i, "type": kind, "name": i, "config": config}

    def edge(a, b, h=""):
        return {"id": a + b, "source": a, "target": b, "targetHandle": h}

    nodes = [
        node("src", "source", table="events", watermark={"column": "ts", "delay": "40 days"}), node("names", "source", table="names"),
        node("some", "filter", expression="value > 5"), node("j", "join", leftKey="user_id", rightKey="id", type="left"), node("rows", "output"),
        node("dear", "filter", expression="value > 50"), node("dear_rows", "output"),
        node("sum", "aggregate", groupBy=["event_type"], aggregations=[{"op": "count", "as": "n"}, {"op": "min", "field": "value", "as": "low"}]),
        node("sums", "output"), node("all", "aggregate", aggregations=[{"op": "count", "as": "n"}]), node("total", "output"),
    ]
    edges = [
        edge("src", "some"), edge("some", "j", "left"), edge("names", "j", "right"), edge("j", "rows"), edge("j", "dear"), edge("dear", "dear_rows"),
        edge("j", "sum"), edge("sum", "sums"), edge("some", "all"), edge("all", "total"),
    ]
    return nodes, edges


def test_flow_over_a_stream_equals_batch(spark, folder, events):
    """Four outputs over growing input, each call going on where the last ended."""
    nodes, edges = flow_parts()
    names = spark.range(0, 2000, 2).select("id", F.concat(F.lit("u"), "id").alias("name"))
    parts = events.repartition(4, "event_id").withColumn("p", F.pmod("event_id", F.lit(3)))
    seen = None
    for p in range(3):
        parts.where(F.col("p") == p).drop("p").write.mode("append").parquet(folder + "/in")
        seen = parts.where(F.col("p") <= p).drop("p")
        stream = stream_files(spark, folder + "/in", events.schema, max_files_per_trigger=2)
        done = drain_flow(spark, {"nodes": nodes, "edges": edges}, {"events": stream, "names": names}, folder + "/flow")
        batch = run_flow(spark, {"nodes": nodes, "edges": edges}, {"events": seen, "names": names})
        for out in ("rows", "dear_rows", "sums", "total"):
            assert same(done.frames[out].df, batch.frames[out].df.select(done.frames[out].df.columns)), out
    again = drain_flow(spark, {"nodes": nodes, "edges": edges}, {"events": stream, "names": names}, folder + "/flow")
    assert same(again.frames["sums"].df, batch.frames["sums"].df) and same(again.frames["rows"].df, batch.frames["rows"].df)


def test_flow_over_a_stream_drops_late_rows_of_a_window(spark, folder):
    """The watermark of the source bounds a windowed aggregate."""
    definition = {
        "nodes": [
            {"id": "s", "type": "source", "config": {"table": "t", "watermark": {"column": "ts", "delay": "1 hour"}}},
            {"id": "w", "type": "transform", "config": {"columns": {"hour": "window(ts, '1 hour')"}}},
            {"id": "a", "type": "aggregate", "config": {"groupBy": ["hour"], "aggregations": [{"op": "count", "as": "n"}]}},
        ],
        "edges": [{"id": "1", "source": "s", "target": "w"}, {"id": "2", "source": "w", "target": "a"}],
    }
    for hours in ((1, 10), (11, 1, 9)):
        spark.createDataFrame([(datetime(2024, 1, 1, h, 30),) for h in hours], "ts timestamp").coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = stream_files(spark, folder + "/in", "ts timestamp")
        found = drain_flow(spark, definition, {"t": stream}, folder + "/flow").frames["a"].df
    assert {r["hour"]["start"].hour: r["n"] for r in found.collect()} == {1: 1, 10: 1, 11: 1, 9: 1}


def test_flows_that_a_stream_cannot_run(spark, folder, events):
    nodes, edges = flow_parts()
    stream = stream_files(spark, f"{SF_DIR}/events.parquet", events.schema)
    with pytest.raises(ValueError, match="only one stream"):
        drain_flow(spark, {"nodes": nodes, "edges": edges}, {"events": stream, "names": stream}, folder)
    capped = [{**n, "config": {**n["config"], "max_rows": 5}} if n["id"] == "some" else n for n in nodes]
    with pytest.raises(ValueError, match="row cap"):
        drain_flow(spark, {"nodes": capped, "edges": edges}, {"events": stream, "names": spark.range(3)}, folder)
