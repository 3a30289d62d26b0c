"""Declarative flow definitions: nodes, edges, and their structural rules."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

# The built-in node types and the size limits of a definition.
NODE_TYPES = ("source", "transform", "filter", "join", "aggregate", "output")
MAX_NODES = 200
MAX_EDGES = 500


class DefinitionError(ValueError):
    """A definition breaks a structural rule."""


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    name: str = ""
    config: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    target: str
    handle: str = ""


@dataclass(frozen=True)
class Definition:
    nodes: tuple[Node, ...] = ()
    edges: tuple[Edge, ...] = ()

    def node(self, node_id: str) -> Node:
        return next(n for n in self.nodes if n.id == node_id)

    def inputs_of(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node_id]

    def terminals(self) -> list[str]:
        used = {e.source for e in self.edges}
        return [n.id for n in self.nodes if n.id not in used]


def parse_definition(raw: str | Mapping[str, Any] | None) -> Definition:
    """Read `{nodes: [...], edges: [...]}`; unknown keys such as positions are ignored."""
    if not raw:
        return Definition()
    try:
        data = json.loads(raw) if isinstance(raw, str) else raw
        nodes = tuple(
            Node(n.get("id", ""), n.get("type", ""), n.get("name", ""), n.get("config") or {})
            for n in data.get("nodes") or ()
        )
        edges = tuple(
            Edge(e.get("id", ""), e.get("source", ""), e.get("target", ""), e.get("targetHandle") or "")
            for e in data.get("edges") or ()
        )
    except (ValueError, AttributeError) as error:
        raise DefinitionError(f"the definition cannot be read: {error}") from error
    return Definition(nodes, edges)


def topological_order(definition: Definition) -> list[str]:
    """Node ids with every node after its inputs; ties in definition order."""
    graph = {n.id: [e.source for e in definition.inputs_of(n.id)] for n in definition.nodes}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as error:
        raise DefinitionError(f"these nodes feed each other in a cycle: {', '.join(error.args[1])}") from error


def problems(definition: Definition, node_types: Collection[str] = NODE_TYPES) -> list[str]:
    """Everything that is wrong with the nodes and edges by themselves."""
    times = Counter(n.id for n in definition.nodes)
    found = []
    for what, count, most in (("nodes", len(definition.nodes), MAX_NODES), ("edges", len(definition.edges), MAX_EDGES)):
        if count > most:
            found.append(f"{count} {what} are more than {most}")
    if times[""]:
        found.append(f"{times['']} nodes have no id")
    found += [f"{n} nodes are called {i!r}" for i, n in times.items() if i and n > 1]
    found += [f"{n.id!r} is of the type {n.type!r}, which nobody registered" for n in definition.nodes if n.type not in node_types]
    for edge in definition.edges:
        found += [f"edge {edge.id!r} leads to or from {end!r}, which is no node" for end in (edge.source, edge.target) if end not in times]
    return found


def validate(definition: Definition, node_types: Collection[str] = NODE_TYPES) -> list[str]:
    """The order of execution; one error that lists all problems if there are any."""
    if found := problems(definition, node_types):
        raise DefinitionError("; ".join(found))
    return topological_order(definition)
