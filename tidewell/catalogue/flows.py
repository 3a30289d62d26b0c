"""Declarative flows, run logs and exports."""

from __future__ import annotations

import contextlib

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.catalogue.sources import graphql_pages
from tidewell.frame import Frame, Meta
from tidewell.plans import append_run, deliver, latest_runs, run_flow, settle, with_metrics
from tidewell.session import scratch_dir
from tidewell.sinks import (
    read_envelope, write_csv, write_envelope, write_json, write_json_array, write_ndjson, write_parquet, write_tsv,
)
from tidewell.sources import read_csv, read_json_documents, read_ndjson, read_parquet


def _node(node_id, node_type, **config):
    return {"id": node_id, "type": node_type, "name": node_id, "config": config}


def _edge(source, target, handle=""):
    return {"id": f"{source}-{target}", "source": source, "target": target, "targetHandle": handle}


LINEAR = {
    "nodes": [
        _node("orders", "source", table="orders"),
        _node("dear", "filter", expression="o_totalprice > 200000 AND o_orderstatus = 'O'"),
        _node("shape", "transform", columns={"order_id": "o_orderkey", "price": "o_totalprice", "year": "year(o_orderdate)"}),
        _node("out", "output"),
    ],
    "edges": [_edge("orders", "dear"), _edge("dear", "shape"), _edge("shape", "out")],
}

JOIN_AGG = {
    "nodes": [
        _node("orders", "source", table="orders"),
        _node("customers", "source", table="customer"),
        _node("large", "filter", expression="o_totalprice > 100000"),
        _node("with_customer", "join", leftKey="o_custkey", rightKey="c_custkey", type="left"),
        _node("shape", "transform", columns={
            "segment": "c_mktsegment", "price": "o_totalprice", "balance": "c_acctbal", "order_id": "o_orderkey",
        }),
        _node("by_segment", "aggregate", groupBy=["segment"], aggregations=[
            {"op": "sum", "field": "price", "as": "total_price"}, {"op": "avg", "field": "balance", "as": "mean_balance"},
            {"op": "count", "field": "order_id", "as": "orders"}, {"op": "max", "field": "price"},
        ]),
        _node("out", "output"),
    ],
    "edges": [
        _edge("orders", "large"), _edge("large", "with_customer", "left"), _edge("customers", "with_customer", "right"),
        _edge("with_customer", "shape"), _edge("shape", "by_segment"), _edge("by_segment", "out"),
    ],
}

FANOUT = {
    "nodes": [
        _node("lines", "source", table="lineitem"),
        _node("large", "filter", expression="l_quantity > 25"),
        _node("by_part", "aggregate", groupBy=["l_partkey"], aggregations=[{"op": "sum", "field": "l_quantity"}]),
        _node("by_supplier", "aggregate", groupBy=["l_suppkey"], aggregations=[{"op": "count", "field": "l_orderkey"}]),
        _node("parts", "source", sql="SELECT p_partkey, p_brand FROM part WHERE p_size < 25"),
        _node("branded", "join", leftKey="l_partkey", rightKey="p_partkey"),
        _node("by_brand", "aggregate", groupBy=["p_brand"], aggregations=[
            {"op": "sum", "field": "sum_l_quantity", "as": "quantity"}, {"op": "count", "as": "parts"},
        ]),
        _node("brands_out", "output"),
        _node("suppliers_out", "output"),
    ],
    "edges": [
        _edge("lines", "large"), _edge("large", "by_part"), _edge("large", "by_supplier"),
        _edge("by_part", "branded", "left"), _edge("parts", "branded", "right"), _edge("branded", "by_brand"),
        _edge("by_supplier", "suppliers_out"), _edge("by_brand", "brands_out"),
    ],
}

CAPPED = {
    "nodes": [
        _node("orders", "source", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", max_rows=120),
        _node("out", "output"),
    ],
    "edges": [_edge("orders", "out")],
}


CAPPED_LATE = {
    "nodes": [
        _node("orders", "source", table="orders"), _node("dear", "filter", expression="o_totalprice > 200000"),
        _node("few", "transform", columns={"order_id": "o_orderkey"}, max_rows=5), _node("last", "output"),
    ],
    "edges": [_edge("orders", "dear"), _edge("dear", "few"), _edge("few", "last")],
}

FAILING = {
    "nodes": [
        _node("orders", "source", table="orders"),
        _node("check", "transform", columns={"order_id": "if(o_orderkey < 0, o_orderkey, raise_error('no such order'))"}),
        _node("out", "output"),
    ],
    "edges": [_edge("orders", "check"), _edge("check", "out")],
}


def _exporting(folder):
    return {
        "nodes": [
            _node("orders", "source", table="orders"), _node("dear", "filter", expression="o_totalprice > 300000"),
            _node("file", "output", target={"format": "json_array", "path": folder + "/{{workflow_id}}/dear"}),
            _node("by_status", "aggregate", groupBy=["o_orderstatus"], aggregations=[{"op": "count", "as": "n"}]),
            _node("table", "output", target={"format": "parquet", "path": folder + "/{{workflow_id}}/by_status"}),
        ],
        "edges": [_edge("orders", "dear"), _edge("dear", "file"), _edge("dear", "by_status"), _edge("by_status", "table")],
    }


def _tables(spark, d, *names):
    return {n: table(spark, d, n) for n in names}


def _flow_linear(spark, d):
    return run_flow(spark, LINEAR, _tables(spark, d, "orders")).output.df


def flow_join_agg(spark, d):
    out = run_flow(spark, JOIN_AGG, _tables(spark, d, "orders", "customer")).output.df
    return out.select(
        "segment", F.round("total_price", 2).alias("total_price"), F.round("mean_balance", 4).alias("mean_balance"),
        "orders", "max_price",
    )


def _flow_fanout(spark, d):
    result = run_flow(spark, FANOUT, _tables(spark, d, "lineitem", "part"), share=True)
    brands, suppliers = result.frames["brands_out"].df, result.frames["suppliers_out"].df
    return brands.select(
        F.col("p_brand").alias("name"), "quantity", F.col("parts").alias("n")
    ).unionAll(suppliers.select(F.col("l_suppkey").cast("string"), F.lit(None).cast("double"), "count_l_orderkey"))


def _flow_capped(spark, d):
    return run_flow(spark, CAPPED, _tables(spark, d, "orders")).output.df


def _flow_metrics(spark, d):
    tables = _tables(spark, d, "orders", "customer")
    nodes = [n for flow in (JOIN_AGG, CAPPED_LATE) for n in with_metrics(spark, flow, tables).nodes]
    rows = [(n.node_id, n.type, n.rows_out, bool(n.truncated)) for n in nodes]
    return spark.createDataFrame(rows, "node string, type string, rows_out long, truncated boolean")


def _run_log(spark, d):
    path = scratch_dir(spark, "runs") + "/log"
    for name, flow in (("linear", LINEAR), ("join_agg", JOIN_AGG)):
        append_run(spark, path, name, "user-1", lambda flow=flow: with_metrics(spark, flow, _tables(spark, d, "orders", "customer")))
    with contextlib.suppress(PySparkException):
        append_run(spark, path, "failing", "user-1", lambda: run_flow(spark, FAILING, _tables(spark, d, "orders")))
    nodes = F.from_json("node_results", "array<struct<node_id string, rows_out bigint, error string>>")
    return latest_runs(spark, path).select("workflow_id", "status", "triggered_by", F.inline(nodes)).withColumn(
        "error", F.regexp_extract("error", "no such order", 0)
    )


def _flow_export(spark, d):
    """A flow whose outputs have targets, read back from them."""
    folder = scratch_dir(spark, "flow")
    result = run_flow(spark, _exporting(folder), _tables(spark, d, "orders"))
    written = deliver(result, {"workflow_id": "dear-orders"})
    listed = read_json_documents(spark, written["file"], "o_orderkey long, o_totalprice double, o_orderstatus string")
    counts = read_parquet(spark, written["table"])
    return listed.select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_totalprice").alias("amount")).unionAll(
        counts.select("o_orderstatus", F.col("n").cast("double"))
    )


GUARDED = {
    "nodes": [
        _node("documents", "source", table="documents", max_columns=4, max_string_bytes=2_000, dictionary_threshold=128),
        _node("cut", "filter", expression="text LIKE '%(truncated)'"),
        _node("by_lang", "aggregate", groupBy=["lang"], aggregations=[{"op": "count", "as": "n"}]), _node("out", "output"),
    ],
    "edges": [_edge("documents", "cut"), _edge("cut", "by_lang"), _edge("by_lang", "out")],
}


def _flow_guarded_source(spark, d):
    """A flow over a guarded source; its rows, and what its one run noted about the source."""
    planned = run_flow(spark, GUARDED, _tables(spark, d, "documents"))
    path = scratch_dir(spark, "guarded") + "/rows"
    write_parquet(planned.output.df, path)
    meta = settle(planned).frames["documents"].meta
    notes = [("warning", w, None) for w in meta.warnings] + [("dictionary", c, n) for c, n in meta.extra["dictionaryColumns"].items()]
    notes = spark.createDataFrame([*notes, ("rows", "documents", meta.row_count)], "kind string, name string, n long")
    return read_parquet(spark, path).select(F.lit("result").alias("kind"), F.col("lang").alias("name"), "n").unionAll(notes)


GRAPHQL = {
    "nodes": [
        _node("pages", "source", kind="graphql", table="pages", data_path="data.search", errors="skip", schema="id long, status string, price double"),
        _node("dear", "filter", expression="price > 1000"),
        _node("by_status", "aggregate", groupBy=["status"], aggregations=[
            {"op": "count", "as": "n"}, {"op": "min", "field": "price", "as": "low"}, {"op": "max", "field": "id", "as": "last"},
        ]),
        _node("out", "output"),
    ],
    "edges": [_edge("pages", "dear"), _edge("dear", "by_status"), _edge("by_status", "out")],
}


def _flow_graphql(spark, d):
    return run_flow(spark, GRAPHQL, {"pages": graphql_pages(spark, d)}).output.df


WINDOWED = {
    "nodes": [
        _node("late", "source", kind="time_window", tables=["events", "more"], time_column="ts", start="2024-01-10T00:00:00", end="2024-01-12T00:00:00"),
        _node("by_type", "aggregate", groupBy=["event_type"], aggregations=[{"op": "count", "as": "n"}, {"op": "max", "field": "event_id", "as": "last"}]),
        _node("out", "output"),
    ],
    "edges": [_edge("late", "by_type"), _edge("by_type", "out")],
}


def _flow_time_window(spark, d):
    """Two log tables, one below the other, within two days."""
    events = table(spark, d, "events")
    return run_flow(spark, WINDOWED, {"events": events.where("event_id % 2 = 0"), "more": events.where("event_id % 2 = 1").drop("props")}).output.df


def _export_csv(spark, d):
    path = scratch_dir(spark, "export") + "/documents.csv"
    write_csv(table(spark, d, "documents"), path)
    return read_csv(spark, path, multi_line=True)


def _export_json(spark, d):
    path = scratch_dir(spark, "export") + "/events.ndjson"
    write_json(table(spark, d, "events"), path)
    return read_ndjson(
        spark, path, "event_id long, ts string, user_id long, event_type string, value double, props string"
    )


def _export_ndjson(spark, d):
    path = scratch_dir(spark, "export") + "/conversations.ndjson"
    write_ndjson(table(spark, d, "conversations"), path)
    return read_ndjson(spark, path, "conv_id long, turn long, role string, text string")


def _export_json_array(spark, d):
    path = scratch_dir(spark, "export") + "/lines"
    write_json_array(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), path)
    return read_json_documents(spark, path, "l_orderkey long, l_linenumber long, l_partkey long, l_shipdate string")


def _export_envelope(spark, d):
    path = scratch_dir(spark, "export") + "/customer"
    write_envelope(Frame(table(spark, d, "customer"), Meta(name="customer", source_type="table")), path)
    frame = read_envelope(spark, path)
    return frame.df.withColumn("source", F.lit(frame.meta.name))


def _export_parquet(spark, d):
    path = scratch_dir(spark, "export") + "/orders"
    write_parquet(table(spark, d, "orders"), path, "zstd", ["o_orderstatus"])
    return read_parquet(spark, path, ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"])


def _export_tsv(spark, d):
    path = scratch_dir(spark, "export") + "/part.tsv"
    write_tsv(table(spark, d, "part"), path)
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


QUERIES = {
    "flow_linear": _flow_linear,
    "flow_join_agg": flow_join_agg,
    "flow_fanout": _flow_fanout,
    "flow_capped": _flow_capped,
    "flow_metrics": _flow_metrics,
    "run_log": _run_log,
    "flow_export": _flow_export,
    "flow_guarded_source": _flow_guarded_source,
    "flow_graphql": _flow_graphql,
    "flow_time_window": _flow_time_window,
    "export_json_array": _export_json_array,
    "export_csv": _export_csv,
    "export_json": _export_json,
    "export_ndjson": _export_ndjson,
    "export_envelope": _export_envelope,
    "export_parquet": _export_parquet,
    "export_tsv": _export_tsv,
}

_DEAR = "(SELECT count(*) FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O')"
_LARGE = "(SELECT count(*) FROM orders WHERE o_totalprice > 100000)"
_SEGMENTS = """(SELECT count(*) FROM (SELECT c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey
                WHERE o_totalprice > 100000 GROUP BY 1))"""
_NODE_COUNTS = (
    ("orders", "source", "(SELECT count(*) FROM orders)"), ("customers", "source", "(SELECT count(*) FROM customer)"),
    ("large", "filter", _LARGE), ("with_customer", "join", _LARGE), ("shape", "transform", _LARGE),
    ("by_segment", "aggregate", _SEGMENTS), ("out", "output", _SEGMENTS),
)
_ABOVE = "(SELECT count(*) FROM orders WHERE o_totalprice > 200000)"
_LATE_COUNTS = (
    ("orders", "source", "(SELECT count(*) FROM orders)", False), ("dear", "filter", _ABOVE, False),
    ("few", "transform", "CAST(5 AS BIGINT)", True), ("last", "output", "CAST(5 AS BIGINT)", False),
)

ORACLE = {
    "flow_linear": """
        SELECT o_orderkey AS order_id, o_totalprice AS price, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
        WHERE o_totalprice > 200000 AND o_orderstatus = 'O'""",
    "flow_join_agg": """
        SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total_price,
               round(coalesce(avg(c_acctbal), 0), 4) AS mean_balance, count(*) AS orders, max(o_totalprice) AS max_price
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1""",
    "flow_fanout": """
        SELECT p_brand AS name, sum(q) AS quantity, count(*) AS n
        FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
        JOIN part ON l_partkey = p_partkey WHERE p_size < 25 GROUP BY 1
        UNION ALL
        SELECT CAST(l_suppkey AS VARCHAR), NULL, count(*) FROM lineitem WHERE l_quantity > 25 GROUP BY l_suppkey""",
    "flow_capped": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 120",
    "flow_metrics": " UNION ALL ".join(
        f"SELECT '{n}' AS node, '{t}' AS type, {c} AS rows_out, {cut} AS truncated"
        for n, t, c, cut in (*((*x, False) for x in _NODE_COUNTS), *_LATE_COUNTS)
    ),
    "run_log": " UNION ALL ".join(
        [
            f"SELECT 'join_agg' AS workflow_id, 'succeeded' AS status, 'user-1' AS triggered_by, '{n}' AS node_id, {c} AS rows_out, '' AS error"
            for n, _, c in _NODE_COUNTS
        ]
        + [
            f"SELECT 'linear', 'succeeded', 'user-1', '{n}', {c}, ''"
            for n, c in (("orders", "(SELECT count(*) FROM orders)"), ("dear", _DEAR), ("shape", _DEAR), ("out", _DEAR))
        ]
        + [
            f"SELECT 'failing', 'failed', 'user-1', '{n}', NULL, '{e}'"
            for n, e in (("orders", ""), ("check", "no such order"), ("out", ""))
        ]
    ),
    "flow_guarded_source": """
        WITH few AS (
            SELECT 'lang' AS name, count(DISTINCT lang) AS n FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
            UNION ALL SELECT 'text', count(DISTINCT text) FROM documents)
        SELECT 'result' AS kind, lang AS name, count(*) AS n FROM documents WHERE octet_length(encode(text)) > 2000 GROUP BY lang
        UNION ALL SELECT 'dictionary', name, n FROM few WHERE n BETWEEN 1 AND 128
        UNION ALL SELECT 'rows', 'documents', count(*) FROM documents
        UNION ALL SELECT 'warning', count(*) || ' cell(s) exceeded per-type cell limits and were truncated', NULL FROM documents
            WHERE octet_length(encode(text)) > 2000
        UNION ALL SELECT 'warning', 'Column cap reached at 4 columns.', NULL""",
    "flow_graphql": """
        SELECT o_orderstatus AS status, count(*) AS n, min(o_totalprice) AS low, CAST(max(o_orderkey) AS DOUBLE) AS last FROM (
            SELECT *, max(o_totalprice) OVER (PARTITION BY o_orderkey // 1000, (o_orderkey % 1000) // 50) AS dearest FROM orders)
        WHERE dearest <= 499000 AND o_totalprice > 1000 GROUP BY 1""",
    "flow_time_window": """
        SELECT event_type, count(*) AS n, CAST(max(event_id) AS DOUBLE) AS last FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1""",
    "flow_export": """
        SELECT CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS amount FROM orders WHERE o_totalprice > 300000
        UNION ALL SELECT o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders WHERE o_totalprice > 300000 GROUP BY 1""",
    "export_json_array": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS l_shipdate FROM lineitem""",
    "export_csv": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "export_json": r"""
        SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z' AS ts, user_id,
               event_type, value, props FROM events""",
    "export_ndjson": "SELECT conv_id, turn, role, text FROM conversations",
    "export_envelope": "SELECT *, 'customer' AS source FROM customer",
    "export_parquet": "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders",
    "export_tsv": r"""
        SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
               regexp_replace(CAST(p_retailprice AS VARCHAR), '\.0$', '') AS p_retailprice FROM part""",
}
