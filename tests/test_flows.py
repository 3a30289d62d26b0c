"""Flow definitions: rules, wiring, results, run log."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import plan_of
from tidewell.plans.run import shared_nodes
from tidewell.plans import (
    DefinitionError, NodeFailure, append_run, compact_runs, deliver, latest_runs, parse_definition, register_node, run_flow,
    topological_order, validate, with_metrics,
)
from tidewell.plans.runlog import append_skipped
from tidewell.session import scratch_dir
from tidewell.sources import read_csv, read_ndjson


def node(node_id, kind="output", **config):
    return {"id": node_id, "type": kind, "name": f"n-{node_id}", "config": config, "position": {"x": 1, "y": 2}}


def edge(source, target, handle=""):
    return {"id": f"{source}>{target}", "source": source, "target": target, "targetHandle": handle}


def flow(nodes, edges):
    return {"nodes": nodes, "edges": edges}


@pytest.fixture
def people(spark):
    return {"people": spark.createDataFrame([("alice", 150.0), ("bob", 20.0), ("carol", None)], "name string, amount double")}


CHAIN = flow(
    [
        node("src", "source", table="people"), node("flt", "filter", expression="amount > 100"),
        node("tr", "transform", columns={"who": "name"}), node("out"),
    ],
    [edge("src", "flt"), edge("flt", "tr"), edge("tr", "out")],
)


def test_chain(spark, people):
    result = run_flow(spark, json.dumps(CHAIN), people)
    assert [r.asDict() for r in result.output.df.collect()] == [{"who": "alice"}]
    assert [n.node_id for n in result.nodes] == ["src", "flt", "tr", "out"] and result.ok
    # Every ancestor once, oldest first.
    assert result.output.meta.lineage == ("people", "n-flt")
    assert result.frames["flt"].meta.source_type == "node:filter"


def test_metrics(spark, people):
    result = with_metrics(spark, CHAIN, people)
    assert {n.node_id: n.rows_out for n in result.nodes} == {"src": 3, "flt": 1, "tr": 1, "out": 1}


def test_failing_node(spark, people):
    bad = flow([node("src", "source", table="people"), node("flt", "filter", expression="amount >> nope(")], [edge("src", "flt")])
    with pytest.raises(NodeFailure, match="filter 'flt' cannot be planned") as caught:
        run_flow(spark, bad, people)
    assert caught.value.result.failed_node == "flt"
    assert [n.node_id for n in caught.value.result.nodes] == ["src", "flt"]
    missing = flow([node("src", "source", table="people"), node("a", "aggregate", groupBy=["name"])], [edge("src", "a")])
    with pytest.raises(NodeFailure, match="nothing to aggregate"):
        run_flow(spark, missing, people)
    with pytest.raises(NodeFailure, match='"left" and one at "right"'):
        run_flow(spark, flow([node("src", "source", table="people"), node("j", "join")], [edge("src", "j")]), people)
    with pytest.raises(NodeFailure, match="nothing is connected"):
        run_flow(spark, flow([node("o")], []))


def test_cap_and_soft_warning(spark):
    tables = {"n": spark.range(100).toDF("n")}

    def capped(cap):
        result = with_metrics(spark, flow([node("src", "source", table="n", max_rows=cap), node("out")], [edge("src", "out")]), tables)
        return result.nodes[0], result.output.df.count()

    src, rows = capped(40)
    assert (src.truncated, src.rows_out, rows) == (True, 40, 40) and "Row cap reached" in src.warnings[0]
    src, rows = capped(110)
    assert (src.truncated, src.rows_out, rows) == (False, 100, 100) and "at least 80%" in src.warnings[0]
    src, _ = capped(1000)
    assert src.warnings == ()


def test_last_output_wins_and_fan_out(spark, people):
    both = flow(
        [node("src", "source", table="people"), node("one"), node("big", "filter", expression="amount > 100"), node("two"), node("tail", "transform", expression="name")],
        [edge("src", "one"), edge("src", "big"), edge("big", "two"), edge("src", "tail")],
    )
    result = run_flow(spark, both, people, persist=["src"])
    assert result.output is result.frames["two"] and result.output.df.count() == 1
    assert result.frames["tail"].df.columns == ["value"]
    result.frames["src"].df.unpersist()
    without = flow(both["nodes"][:1], [])
    assert run_flow(spark, without, people).output.df.count() == 3
    assert run_flow(spark, flow([], [])).output is None


def test_join_node_and_custom_node(spark, people):
    register_node("shout", lambda inputs, config: inputs[0].withColumn("loud", F.concat(F.upper("name"), F.lit(config["mark"]))))
    joined = flow(
        [
            node("a", "source", table="people"), node("b", "source", table="people"), node("loud", "shout", mark="!"),
            node("j", "join", leftKey="name", rightKey="name", type="left", rightPrefix="r_"), node("out"),
        ],
        [edge("a", "j", "left"), edge("b", "loud"), edge("loud", "j", "right"), edge("j", "out")],
    )
    result = run_flow(spark, joined, people)
    assert result.output.df.columns == ["name", "amount", "r_name", "r_amount", "loud"]
    assert {r["loud"] for r in result.output.df.collect()} == {"ALICE!", "BOB!", "CAROL!"}
    with pytest.raises(ValueError, match="built in"):
        register_node("join", lambda i, c: i[0])


BROKEN = {
    "cycle": (flow([node("a"), node("b")], [edge("a", "b"), edge("b", "a")]), "cycle"),
    "type": (flow([node("a", "teleport")], []), "nobody registered"),
    "duplicate": (flow([node("a"), node("a")], []), "2 nodes are called"),
    "no id": (flow([node("")], []), "have no id"),
    "dangling source": (flow([node("a")], [edge("x", "a")]), "'x', which is no node"),
    "dangling target": (flow([node("a")], [edge("a", "x")]), "'x', which is no node"),
    "nodes": (flow([node(f"n{i}") for i in range(201)], []), "201 nodes"),
    "edges": (flow([node("a"), node("b")], [edge("a", "b")] * 501), "501 edges"),
}


@pytest.mark.parametrize("case", BROKEN)
def test_broken_definitions(case):
    definition, message = BROKEN[case]
    with pytest.raises(DefinitionError, match=message):
        validate(parse_definition(definition))


def test_all_problems_are_told_at_once():
    definition = parse_definition(flow([node("a", "teleport"), node("a"), node("")], [edge("a", "x")]))
    with pytest.raises(DefinitionError) as caught:
        validate(definition)
    assert str(caught.value).count(";") == 3


def test_parse_and_order():
    assert parse_definition("").nodes == () and parse_definition(None).nodes == ()
    with pytest.raises(DefinitionError, match="cannot be read"):
        parse_definition("{nope")
    limits = flow([node(f"n{i}") for i in range(200)], [])
    assert len(validate(parse_definition(limits))) == 200
    order = topological_order(parse_definition(flow([node(i) for i in "dcba"], [edge("a", "b"), edge("b", "d"), edge("c", "d")])))
    assert order.index("a") < order.index("b") < order.index("d") and order.index("c") < order.index("d")


def test_run_log(spark, people):
    path = scratch_dir(spark, "t") + "/runs"
    append_run(spark, path, "wf", "alice", lambda: run_flow(spark, CHAIN, people))
    bad = flow([node("src", "source", table="nowhere")], [])
    with pytest.raises(NodeFailure):
        append_run(spark, path, "wf", "bob", lambda: run_flow(spark, bad, people))
    append_skipped(spark, path, "wf", "scheduler", "still running")
    got = {r["triggered_by"]: r for r in latest_runs(spark, path).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"alice": "succeeded", "bob": "failed", "scheduler": "skipped"}
    assert len(json.loads(got["alice"]["node_results"])) == 4 and "src" in got["bob"]["error"]
    assert got["alice"]["duration_ms"] >= 0 and got["alice"]["finished_at"] >= got["alice"]["started_at"]
    # Both states of a run stay in the log.
    assert spark.read.parquet(path).count() == 5
    assert compact_runs(spark, path, path + "-compact").count() == 5
    assert len(spark.read.parquet(path + "-compact").inputFiles()) == 1


def test_failure_while_running_is_logged(spark, people):
    path = scratch_dir(spark, "t") + "/runs"
    failing = flow(
        [node("src", "source", table="people"), node("tr", "transform", columns={"x": "raise_error('boom')"}), node("out")],
        [edge("src", "tr"), edge("tr", "out")],
    )
    with pytest.raises(PySparkException):
        append_run(spark, path, "wf", "alice", lambda: run_flow(spark, failing, people))
    (row,) = latest_runs(spark, path).collect()
    errors = {n["node_id"]: n["error"] for n in json.loads(row["node_results"])}
    assert row["status"] == "failed" and "boom" in errors["tr"] and not errors["src"]


def test_outputs_with_targets(spark, people):
    folder = scratch_dir(spark, "t")
    definition = flow(
        [node("src", "source", table="people"), *[node(k, "output", target={"format": k, "path": folder + "/{{run_id}}/" + k}) for k in ("csv", "json", "parquet")]],
        [edge("src", k) for k in ("csv", "json", "parquet")],
    )
    written = deliver(run_flow(spark, definition, people), {"run_id": "r1"})
    assert written["csv"] == f"{folder}/r1/csv"
    assert read_csv(spark, written["csv"]).count() == read_ndjson(spark, written["json"]).count() == spark.read.parquet(written["parquet"]).count() == 3
    with pytest.raises(ValueError, match="unknown output format"):
        deliver(run_flow(spark, flow([node("src", "source", table="people"), node("o", "output", target={"format": "xml", "path": folder})], [edge("src", "o")]), people))


def test_counts_above_a_cap(spark):
    tables = {"n": spark.range(1000).toDF("n")}
    definition = flow([node("src", "source", table="n"), node("few", "filter", expression="n >= 0", max_rows=5), node("out")], [edge("src", "few"), edge("few", "out")])
    got = {n.node_id: (n.rows_out, n.truncated) for n in with_metrics(spark, definition, tables).nodes}
    assert got == {"src": (1000, False), "few": (5, True), "out": (5, False)}


def reads(result, table):
    """How often a run's output plans scan a table's file."""
    return sum(plan_of(result.frames[o].df, "formatted").count(f"/{table}.parquet") for o in ("brands_out", "suppliers_out"))


def test_shared_node_is_computed_once(spark):
    """Both outputs go on from what the filter wrote: its columns that something reads, and no scan of the source any more."""
    from tidewell.catalogue.flows import FANOUT

    tables = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("lineitem", "part")}
    plain, shared = run_flow(spark, FANOUT, tables), run_flow(spark, FANOUT, tables, share=True)
    assert reads(plain, "lineitem") == 2 and reads(shared, "lineitem") == 0
    written = shared.frames["large"].df
    files = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in written.inputFiles()})
    assert sorted(files.columns) == ["l_orderkey", "l_partkey", "l_quantity", "l_suppkey"] or sorted(files.columns) == ["l_partkey", "l_quantity", "l_suppkey"]
    assert written.columns == plain.frames["large"].df.columns
    for out in ("brands_out", "suppliers_out"):
        a, b = (sorted(map(str, r.frames[out].df.collect())) for r in (plain, shared))
        assert a == b and a


def test_which_nodes_are_shared():
    def shared(edges, **kinds):
        ids = sorted({x for e in edges for x in e})
        nodes = [node(i, kinds.get(i, "filter"), **({"sql": "SELECT 1"} if kinds.get(i) == "source" and i == "q" else {"table": "t"})) for i in ids]
        definition = parse_definition(flow(nodes, [edge(a, b) for a, b in edges]))
        return shared_nodes(definition, topological_order(definition))

    assert shared([("a", "b"), ("b", "x"), ("b", "y")], a="source") == ["b"]
    assert shared([("a", "x"), ("a", "y")], a="source") == []  # a table is there to be read
    assert shared([("q", "x"), ("q", "y")], q="source") == ["q"]
    assert shared([("a", "b"), ("b", "c"), ("b", "d"), ("c", "x"), ("d", "x")], a="source") == []  # the ways meet again
    assert shared([("a", "b"), ("b", "c"), ("c", "x"), ("c", "y"), ("b", "z")], a="source") == ["b", "c"]


def test_sharing_keeps_names_that_depend_on_columns(spark, people):
    """A column nobody reads still decides what the other side's column is called."""
    both = flow(
        [
            node("src", "source", table="people"), node("keep", "filter", expression="amount > 0"), node("j", "join", leftKey="name", rightKey="name"),
            node("t", "transform", columns={"n": "right_amount"}), node("out"), node("count", "aggregate", aggregations=[{"op": "count", "as": "n"}]), node("out2"),
        ],
        [edge("src", "keep"), edge("keep", "j", "left"), edge("src", "j", "right"), edge("j", "t"), edge("t", "out"), edge("keep", "count"), edge("count", "out2")],
    )
    plain, shared = run_flow(spark, both, people), run_flow(spark, both, people, share=True)
    for out in ("out", "out2"):
        assert sorted(map(str, plain.frames[out].df.collect())) == sorted(map(str, shared.frames[out].df.collect()))
