from tidewell.plans.definition import Definition, DefinitionError, Edge, Node, parse_definition, topological_order, validate
from tidewell.plans.run import NodeFailure, NodeResult, RunResult, deliver, failing_node, register_node, run_flow, settle, with_metrics
from tidewell.plans.runlog import append_run, compact_runs, latest_runs
from tidewell.plans.stream import drain_flow

__all__ = [
    "Definition", "DefinitionError", "Edge", "Node", "NodeFailure", "NodeResult", "RunResult", "append_run",
    "compact_runs", "deliver", "drain_flow", "failing_node", "latest_runs", "parse_definition", "register_node", "run_flow", "settle", "topological_order", "validate", "with_metrics",
]
