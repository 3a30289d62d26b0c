"""Projection, filters, cells."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidewell.catalogue.inputs import QUERY_LOG, derived, table
from tidewell.frame import Frame, col
from tidewell.functions import chart_number, json_path, query_hash, query_summary, uuid_text
from tidewell.operators import filter_rows, limit_columns, rename, select_existing, transform, truncate_cells


def _select_existing(spark, d):
    return select_existing(table(spark, d, "orders"), ["o_totalprice", "missing", "o_orderkey"])


def _rename(spark, d):
    return rename(table(spark, d, "nation"), {"n_name": "nation", "n_regionkey": "region_id"})


def _filter_bool(spark, d):
    return filter_rows(
        table(spark, d, "lineitem"), "l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01'"
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _filter_truthy(spark, d):
    events = table(spark, d, "events")
    parts = [
        ("number", filter_rows(events, "floor(value / 10)")),
        ("text", filter_rows(events, "nullif(event_type, 'view')")),
        ("array", filter_rows(events, "filter(array(value), v -> v > 50)")),
        ("time", filter_rows(events, "CASE WHEN value > 20 THEN ts END")),
        ("integer", filter_rows(events, "CAST(value AS INT)")),
    ]
    out = None
    for kind, df in parts:
        one = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionAll(one)
    return out


def _transform_reshape(spark, d):
    return transform(
        table(spark, d, "orders"),
        {"order_id": "o_orderkey", "label": "o_orderstatus || '/' || o_orderpriority", "cents": "CAST(round(o_totalprice * 100) AS BIGINT)"},
    )


def _transform_value(spark, d):
    scalar = transform(table(spark, d, "customer"), "upper(c_mktsegment)")
    rows = transform(table(spark, d, "supplier"), "named_struct('value', s_name)")
    return scalar.unionAll(rows)


def _limit_columns(spark, d):
    return limit_columns(Frame(table(spark, d, "customer")), 3).df


def _truncate_cells(spark, d):
    return truncate_cells(table(spark, d, "documents").select("doc_id", "text", "source"), 101)


def _json_path(spark, d):
    events = table(spark, d, "events")
    body = F.concat(F.lit('{"a":{"list":['), F.col("props"), F.lit(',"x"]},"n":null}'))
    v = F.parse_json(body)
    return events.select(
        "event_id",
        F.try_variant_get(json_path(v, "a.list.0.k"), "$", "bigint").alias("k"),
        F.try_variant_get(json_path(v, "a.list.1"), "$", "string").alias("second"),
        json_path(v, "a.list.2").isNull().alias("beyond_missing"),
        json_path(v, "a.other").isNull().alias("other_missing"),
        F.to_json(json_path(v, "a.list")).alias("list_text"),
    )


def _chart_coerce(spark, d):
    events = table(spark, d, "events")
    text = F.expr(
        "CASE event_type WHEN 'error' THEN concat(' ', CAST(value AS STRING), ' ') WHEN 'view' THEN 'n/a' "
        "WHEN 'click' THEN '' WHEN 'signup' THEN 'NaN' ELSE CAST(user_id AS STRING) END"
    )
    return events.select("event_id", chart_number(text, T.StringType()).alias("number"))


def _query_hash(spark, d):
    log = derived(spark, d, QUERY_LOG)
    return log.select("id", query_hash(col("query")).alias("query_hash"))


def _query_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", query_summary(col("text")).alias("summary"))


def _uuid_text(spark, d):
    orders = table(spark, d, "orders")
    raw = F.unhex(F.md5(F.col("o_orderkey").cast("string")))
    return orders.select("o_orderkey", uuid_text(raw).alias("uuid"))


QUERIES = {
    "select_existing": _select_existing,
    "rename": _rename,
    "filter_bool": _filter_bool,
    "filter_truthy": _filter_truthy,
    "transform_reshape": _transform_reshape,
    "transform_value": _transform_value,
    "limit_columns": _limit_columns,
    "truncate_cells": _truncate_cells,
    "json_path": _json_path,
    "chart_coerce": _chart_coerce,
    "query_hash": _query_hash,
    "query_summary": _query_summary,
    "uuid_text": _uuid_text,
}

ORACLE = {
    "select_existing": "SELECT o_totalprice, o_orderkey FROM orders",
    "rename": "SELECT n_nationkey, n_name AS nation, n_regionkey AS region_id FROM nation",
    "filter_bool": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1997-01-01'""",
    "filter_truthy": """
        SELECT event_type, count(*) AS n, 'number' AS kind FROM events WHERE floor(value / 10) <> 0 GROUP BY 1
        UNION ALL
        SELECT event_type, count(*) AS n, 'text' AS kind FROM events WHERE event_type <> 'view' GROUP BY 1
        UNION ALL
        SELECT event_type, count(*) AS n, 'array' AS kind FROM events WHERE value > 50 GROUP BY 1
        UNION ALL
        SELECT event_type, count(*) AS n, 'time' AS kind FROM events WHERE value > 20 GROUP BY 1
        UNION ALL
        SELECT event_type, count(*) AS n, 'integer' AS kind FROM events WHERE trunc(value) <> 0 GROUP BY 1""",
    "transform_reshape": """
        SELECT o_orderkey AS order_id, o_orderstatus || '/' || o_orderpriority AS label,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    "transform_value": "SELECT upper(c_mktsegment) AS value FROM customer UNION ALL SELECT s_name AS value FROM supplier",
    "limit_columns": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "truncate_cells": """
        SELECT doc_id,
               CASE WHEN strlen(text) > 101 THEN
                    left(text, list_max(list_filter(range(20, 102), lambda k: strlen(left(text, k)) <= 101)))
                    || '…(truncated)' ELSE text END AS text,
               source
        FROM documents""",
    "json_path": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'x' AS second,
               TRUE AS beyond_missing, TRUE AS other_missing,
               '[' || replace(props, ' ', '') || ',"x"]' AS list_text FROM events""",
    "chart_coerce": """
        SELECT event_id, CASE event_type WHEN 'error' THEN value WHEN 'view' THEN NULL WHEN 'click' THEN NULL
               WHEN 'signup' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS number FROM events""",
    "query_hash": """
        SELECT event_id AS id, sha256(CASE event_type
               WHEN 'signup' THEN 'SELECT ''-- kept'' FROM t WHERE k = ' || props
               ELSE 'SELECT * FROM t WHERE k = ' || props END) AS query_hash FROM events""",
    "query_summary": r"""
        SELECT doc_id, left(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 80) AS summary
        FROM documents""",
    "uuid_text": """
        SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
               || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid
        FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""",
}
