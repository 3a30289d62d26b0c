"""An append-only log of flow runs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.history import latest_state
from tidewell.plans.run import NodeFailure, RunResult, deliver, failing_node, settle

STATUSES = ("running", "succeeded", "failed", "skipped")
SCHEMA = (
    "run_id string, workflow_id string, seq int, status string, triggered_by string, logged_at timestamp, "
    "started_at timestamp, finished_at timestamp, duration_ms long, error string, node_results string"
)


def _append(spark: SparkSession, path: str, row: Mapping[str, Any]) -> None:
    if row["status"] not in STATUSES:
        raise ValueError(f"unknown run status {row['status']!r}")
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    record = tuple(row.get(n) for n in names)
    spark.createDataFrame([record], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def append_run(
    spark: SparkSession,
    path: str,
    workflow_id: str,
    triggered_by: str,
    run: Callable[[], RunResult],
    sink: Callable[[RunResult], object] | None = None,
) -> RunResult:
    """Plan a flow with `run`, compute it with `sink`, and log its start and its end.

    Without a sink `deliver` computes it: outputs with a target are written, other last nodes computed. So a run is logged as succeeded only
    after its rows were there. A failure is logged, with the node where it is found, and raised again.
    """
    started = datetime.now(timezone.utc)
    clock = time.monotonic()
    base = {
        "run_id": uuid.uuid4().hex, "workflow_id": workflow_id, "triggered_by": triggered_by, "started_at": started,
    }
    _append(spark, path, {**base, "seq": 0, "status": "running", "logged_at": started})

    def finish(status: str, result: RunResult | None, error: str) -> None:
        now = datetime.now(timezone.utc)
        nodes = json.dumps([asdict(n) for n in result.nodes]) if result else "[]"
        _append(
            spark, path,
            {
                **base, "seq": 1, "status": status, "logged_at": now, "finished_at": now, "error": error,
                "duration_ms": int((time.monotonic() - clock) * 1000), "node_results": nodes,
            },
        )

    result: RunResult | None = None
    try:
        result = run()
        if sink:
            sink(result)
        else:
            deliver(result, {"workflow_id": workflow_id, "run_id": base["run_id"]})
    except NodeFailure as failure:
        finish("failed", failure.result, str(failure))
        raise
    except Exception as failure:
        if result is not None:
            result = _blamed(result, str(failure))
        finish("failed", result, str(failure))
        raise
    result = settle(result)
    finish("succeeded", result, "")
    return result


def _blamed(result: RunResult, error: str) -> RunResult:
    """The result with the error at the node whose rows cannot be computed, if one is found."""
    node_id = failing_node(result)
    nodes = tuple(replace(n, error=error) if n.node_id == node_id else n for n in result.nodes)
    return replace(result, nodes=nodes, failed_node=node_id)


def compact_runs(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write the log's rows to a new folder, in as many files as their size asks for; a log has two small files for each run."""
    spark.read.schema(SCHEMA).parquet(path).repartitionByRange("logged_at").write.parquet(target)
    return spark.read.schema(SCHEMA).parquet(target)


def append_skipped(spark: SparkSession, path: str, workflow_id: str, triggered_by: str, reason: str) -> None:
    now = datetime.now(timezone.utc)
    _append(
        spark, path,
        {
            "run_id": uuid.uuid4().hex, "workflow_id": workflow_id, "triggered_by": triggered_by, "seq": 1,
            "status": "skipped", "logged_at": now, "started_at": now, "finished_at": now, "error": reason,
        },
    )


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run in its latest state."""
    log = spark.read.schema(SCHEMA).parquet(path)
    state = [n for n in log.columns if n not in ("run_id", "seq", "logged_at")]
    return latest_state(log, "run_id", ["logged_at", "seq"], state)
