"""Run a flow definition over streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.frame import Frame
from tidewell.plans.definition import Definition, Node, parse_definition, validate
from tidewell.plans.run import RunResult, run_flow
from tidewell.streaming.sinks import drain_updates, run_batches
from tidewell.streaming.source import event_time


def drain_flow(
    spark: SparkSession,
    definition: Definition | Mapping[str, Any] | str,
    tables: Mapping[str, DataFrame],
    folder: str,
) -> RunResult:
    """Run a flow over all that is new in its streams and return it with the frames of its output nodes.

    `tables` holds streams and plain tables alike; what depends on a stream is computed incrementally, and each call with the same `folder`
    goes on where the last one ended.

    - A source node's config may have `watermark: {"column", "delay"}`.
    - Outputs with no aggregate before them are written batch by batch: one query for each stream, which
      is scanned once for all of them. A repeated batch replaces itself.
    - The first aggregate on a way from a stream is a stateful streaming aggregate in update mode; what changed in a batch is written under
      the batch's number, and the newest row of a key counts. All outputs behind it are planned on that table.

    Two streams cannot meet in a join. Row caps are per run and so have no meaning on a stream: they are refused.
    """
    if not isinstance(definition, Definition):
        definition = parse_definition(definition)
    order = validate(definition)
    folder = folder.rstrip("/")
    streams = {i: _streams(definition, i, tables) for i in order}
    for node_id, own in streams.items():
        if len(own) > 1:
            raise ValueError(f"{node_id!r} joins the streams {sorted(own)}; only one stream may reach a node")
        if own and definition.node(node_id).config.get("max_rows"):
            raise ValueError(f"{node_id!r} has a row cap, which a stream cannot keep")

    marked = {**tables, **{n: _marked(node, tables[n]) for node, n in _stream_sources(definition, tables)}}
    planned = run_flow(spark, definition, marked)
    stateful = [i for i in order if definition.node(i).type == "aggregate" and streams[i] and not _aggregated(definition, i)]
    given: dict[str, Frame] = {}
    for node_id in stateful:
        keys = list(definition.node(node_id).config.get("groupBy") or ())
        path = f"{folder}/{node_id}"
        table = drain_updates(planned.frames[node_id].df, keys, f"{path}/rows", f"{path}/checkpoint")
        given[node_id] = Frame(table, planned.frames[node_id].meta)

    outputs = [i for i in definition.terminals() if streams[i] and not _aggregated(definition, i) and i not in given]
    for stream in sorted({n for i in outputs for n in streams[i]}):
        own = [i for i in outputs if stream in streams[i]]
        _drain_rows(spark, definition, tables, stream, own, folder)
        for node_id in own:
            frame = planned.frames[node_id]
            rows = spark.read.schema(frame.df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/{node_id}/rows")
            given[node_id] = Frame(rows, frame.meta)
    done = run_flow(spark, definition, {**tables, **{n: _nothing(spark, tables[n]) for _, n in _stream_sources(definition, tables)}}, given=given)
    return done


def _drain_rows(
    spark: SparkSession, definition: Definition, tables: Mapping[str, DataFrame], stream: str, outputs: Sequence[str], folder: str
) -> None:
    """Write all stateless outputs of one stream from one query."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist() if len(outputs) > 1 else batch
        try:
            frames = run_flow(spark, definition, {**tables, stream: kept}).frames
            for node_id in outputs:
                frames[node_id].df.write.mode("overwrite").parquet(f"{folder}/{node_id}/rows/batch={number}")
        finally:
            if len(outputs) > 1:
                kept.unpersist()

    run_batches(tables[stream], f"{folder}/rows-of-{stream}/checkpoint", write)


def _stream_sources(definition: Definition, tables: Mapping[str, DataFrame]) -> list[tuple[Node, str]]:
    """Source nodes that read a stream, with the stream's name."""
    named = [(n, n.config.get("table", "")) for n in definition.nodes if n.type == "source"]
    return [(n, t) for n, t in named if t in tables and tables[t].isStreaming]


def _streams(definition: Definition, node_id: str, tables: Mapping[str, DataFrame]) -> set[str]:
    """Names of the streams that a node's rows come from."""
    names = {n.id: t for n, t in _stream_sources(definition, tables)}
    return {names[i] for i in _before(definition, node_id) | {node_id} if i in names}


def _before(definition: Definition, node_id: str) -> set[str]:
    found: set[str] = set()
    rest = [node_id]
    while rest:
        sources = {e.source for e in definition.inputs_of(rest.pop())} - found
        found |= sources
        rest += sources
    return found


def _aggregated(definition: Definition, node_id: str) -> bool:
    """Whether an aggregate lies before a node."""
    return any(definition.node(i).type == "aggregate" for i in _before(definition, node_id))


def _marked(node: Node, stream: DataFrame) -> DataFrame:
    mark = node.config.get("watermark")
    return event_time(stream, mark["column"]).withWatermark(mark["column"], mark["delay"]) if mark else stream


def _nothing(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """An empty table that looks like a stream, for planning what lies before a node that is done."""
    return spark.createDataFrame([], stream.schema)
