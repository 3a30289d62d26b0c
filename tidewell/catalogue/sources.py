"""Sources: files, SQL, landed pages, typing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.session import scratch_dir
from tidewell.sinks import write_csv, write_json
from tidewell.sources import (
    all_text, api_items, apply_column_types, broken_lines, crawl_audit, crawl_gaps, graphql_rows, infer_column_types, infer_format, judge_bounded_json, key_lookup,
    list_objects, next_page, read_csv, read_json_documents, read_ndjson, sql_query, time_window, write_lookup_table,
)

PAGE_ITEMS = 50


def _src_csv(spark, d):
    path = scratch_dir(spark, "csv") + "/part"
    write_csv(table(spark, d, "part"), path)
    return read_csv(spark, path)


def _src_csv_ragged(spark, d):
    # Short lines, empty fields and extra fields, as text lines made from the table.
    path = scratch_dir(spark, "csv") + "/nation"
    supplier = table(spark, d, "supplier")
    line = F.expr(
        "CASE WHEN s_acctbal < 2000 THEN CAST(s_suppkey AS STRING) "
        "WHEN s_acctbal < 4000 THEN concat_ws(';', s_suppkey, '', '') "
        "WHEN s_acctbal < 6000 THEN concat_ws(';', s_suppkey, s_name, s_nationkey, 'extra') "
        "ELSE concat_ws(';', s_suppkey, concat('\"', s_name, ';', '\"'), s_nationkey) END"
    )
    # Spark writes the header of a text file only through CSV: one unquoted column does.
    supplier.select(line.alias("key;name;nation")).write.option("header", True).option("sep", "\x01").option(
        "quote", ""
    ).option("emptyValue", "").csv(path)
    return read_csv(spark, path, delimiter=";")


def _src_ndjson(spark, d):
    path = scratch_dir(spark, "ndjson") + "/orders"
    write_json(table(spark, d, "orders"), path)
    return read_ndjson(
        spark, path,
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, "
        "o_orderpriority string",
    )


def _src_ndjson_quarantine(spark, d):
    path = scratch_dir(spark, "ndjson") + "/props"
    events = table(spark, d, "events")
    line = F.expr(
        "CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN '' ELSE props END"
    )
    events.select(line.alias("value")).write.text(path)
    rows = read_ndjson(spark, path, "k long", quarantine=True)
    return rows.groupBy(F.col("_corrupt_record").isNotNull().alias("broken"), "k").agg(F.count(F.lit(1)).alias("n"))


def _src_ndjson_lines(spark, d):
    """Three files with lines cut short, lines that are no object, and blank ones, which only count."""
    path = scratch_dir(spark, "ndjson") + "/lines"
    line = F.expr(
        "CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'signup' THEN CAST(event_id AS STRING) WHEN 'view' THEN '' ELSE props END"
    )
    lines = table(spark, d, "events").select((F.col("event_id") % 3).alias("part"), "event_id", line.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return broken_lines(spark, path).select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "line", "text")


def _src_json_doc(spark, d):
    path = scratch_dir(spark, "json") + "/customers"
    customers = table(spark, d, "customer")
    packed = customers.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("value")
    )
    # Documents that are null, and arrays of which one item is no object.
    mixed = F.explode(F.array(F.lit("null"), F.concat(F.lit('[{"c_custkey":'), -F.col("r_regionkey") - 1, F.lit("},"), "r_regionkey", F.lit("]"))))
    packed = packed.select("value").unionAll(table(spark, d, "region").select(mixed.alias("value")))
    # One document per file.
    packed.write.option("maxRecordsPerFile", 1).text(path)
    return read_json_documents(spark, path, "c_custkey long, c_name string, c_acctbal double")


def _named_pages(spark, d):
    ending = F.expr(
        "CASE WHEN length(html) > 4000 THEN '.CSV' WHEN length(html) > 3000 THEN '.jsonl' "
        "WHEN length(html) > 2000 THEN '.NDJSON' ELSE '' END"
    )
    return table(spark, d, "pages").select("page_id", F.concat("url", ending).alias("path"))


def _src_infer_format(spark, d):
    return _named_pages(spark, d).select("page_id", infer_format(F.col("path")).alias("format"))


def _src_list_objects(spark, d):
    """Objects of a written table: one per market segment, named by the key's values."""
    path = scratch_dir(spark, "objects") + "/customers"
    customers = table(spark, d, "customer")
    customers.repartition("c_mktsegment").select("c_mktsegment", "c_nationkey", "c_custkey").write.partitionBy("c_mktsegment").parquet(path)
    listing = list_objects(spark, path, "*.parquet")
    segment = F.url_decode(F.regexp_extract("key", r"/c_mktsegment=([^/]*)/", 1))
    kind = F.regexp_extract("key", r"\.([a-z]+)$", 1)
    return listing.groupBy(segment.alias("segment"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("objects"), (F.min("size") > 0).alias("filled"), F.min(F.col("lastModified").isNotNull()).alias("dated")
    )


def _src_text_typed(spark, d):
    customers = table(spark, d, "customer")
    return all_text(customers.withColumn("raw", F.encode("c_name", "UTF-8")))


def _sql(names, sql, params=None):
    def run(spark, d):
        return sql_query(spark, sql, params, {n: table(spark, d, n) for n in names})

    return run


SQL_CTE = """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS customers, round(avg(total), 2) AS mean_spend
FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
"""
SQL_PARAMS = """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN ? AND ? AND o_orderstatus = ?
"""
SQL_WINDOW = """
SELECT o_custkey, o_orderkey, o_totalprice,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_before
FROM orders
"""
SQL_ROLLUP = """
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS all_flags, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
"""
SQL_SETOPS = """
SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier
UNION ALL
(SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
"""
SQL_SEMI_ANTI = """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
"""
SQL_SUBQUERY = """
SELECT p_partkey, p_brand, p_retailprice FROM part p
WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)
"""
SQL_DISTINCT = """
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
       count(*) FILTER (WHERE l_discount > 0.05) AS discounted
FROM lineitem GROUP BY l_returnflag HAVING count(*) > 1
"""


def _landed(spark, d):
    """Order rows packed to API pages: 20 pages of 50 items per crawl."""
    orders = table(spark, d, "orders")
    item = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )
    crawl = F.floor(F.col("o_orderkey") / 1000)
    number = F.floor((F.col("o_orderkey") - crawl * 1000) / PAGE_ITEMS).cast("int")
    # A page holds 50 orders at most, so this collects no large group.
    packed = orders.groupBy(crawl.alias("crawl"), number.alias("page_no")).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.max("o_totalprice").alias("dearest")
    )
    return packed.select(F.concat(F.lit("crawl-"), F.col("crawl")).alias("crawl_id"), "page_no", "items", "dearest")


def _rest_pages(spark, d):
    """Pages of which every eleventh crawl's fifth is short, every thirteenth's sixth empty, every seventeenth's last broken."""
    landed = _landed(spark, d)
    more = F.col("page_no") < 19
    crawl = F.regexp_extract("crawl_id", "[0-9]+$", 0).cast("int")
    items = (
        F.when((crawl % 11 == 3) & (F.col("page_no") == 4), F.slice("items", 1, 7))
        .when((crawl % 13 == 4) & (F.col("page_no") == 5), F.slice("items", 1, 0)).otherwise(F.col("items"))
    )
    body = F.to_json(
        F.struct(F.struct(items.alias("items")).alias("data"), F.when(more, F.col("page_no") + 1).alias("next_cursor"))
    )
    body = F.when((crawl % 17 == 5) & ~more, F.substring(body, 1, 60)).otherwise(body)
    link = F.when(
        more,
        F.concat(
            F.lit('<https://api.test/x?page=0>; rel="first", <https://api.test/x?ids=1,2&page='), F.col("page_no") + 1,
            F.lit('>; rel="next"'),
        ),
    ).otherwise(F.lit('<https://api.test/x?page=0>; rel="first"'))
    return landed.select("crawl_id", "page_no", F.lit(200).alias("status"), link.alias("link_header"), body.alias("body"))


def graphql_pages(spark, d):
    landed = _landed(spark, d)
    edges = F.transform("items", lambda i: F.struct(i.alias("node")))
    info = F.struct((F.col("page_no") < 19).alias("hasNextPage"), F.concat(F.lit("c"), F.col("page_no")).alias("endCursor"))
    good = F.to_json(F.struct(F.struct(F.struct(edges.alias("edges"), info.alias("pageInfo")).alias("search")).alias("data")))
    bad = F.concat(F.lit('{"errors":[{"message":"item too dear on page '), F.col("page_no"), F.lit('"}]}'))
    body = F.when(F.col("dearest") > 499000, bad).otherwise(good)
    return landed.select("crawl_id", "page_no", F.lit(200).alias("status"), F.lit(None).cast("string").alias("link_header"), body.alias("body"))


ITEM = "id long, status string, price double"


def _src_api_items(spark, d):
    # A broken page fails the read; which ones are is known here.
    whole = "NOT (page_no = 19 AND CAST(substr(crawl_id, 7) AS INT) % 17 = 5)"
    return api_items(_rest_pages(spark, d).where(whole), "data.items", ITEM).select("crawl_id", "page_no", "id", "status", "price")


def _src_graphql_edges(spark, d):
    rows, _ = graphql_rows(graphql_pages(spark, d), "data.search", ITEM)
    return rows.select("crawl_id", "page_no", "id", "status", "price")


def _src_graphql_errors(spark, d):
    return graphql_rows(graphql_pages(spark, d), "data.search", ITEM)[1]


def _src_next_page(spark, d):
    rest, graph = _rest_pages(spark, d), graphql_pages(spark, d)
    runs = [
        ("offset", next_page(rest, "offset", "data.items", PAGE_ITEMS)),
        ("page", next_page(rest, "page", "data.items", PAGE_ITEMS)),
        ("cursor", next_page(rest, "cursor", "next_cursor")),
        ("link", next_page(rest, "link")),
        ("relay", next_page(graph, "relay", "data.search")),
    ]
    out = None
    for name, df in runs:
        one = df.select(F.lit(name).alias("strategy"), "crawl_id", "page_no", "next_token", "broken")
        out = one if out is None else out.unionAll(one)
    return out


def _torn_crawls(spark, d):
    """Pages with a very dear order are lost, which leaves gaps; every seventh landed twice."""
    pages = next_page(_rest_pages(spark, d), "offset", "data.items", PAGE_ITEMS)
    lost = _landed(spark, d).where("dearest > 499500").select("crawl_id", "page_no")
    kept = pages.join(lost, ["crawl_id", "page_no"], "left_anti")
    return kept.unionAll(kept.where("page_no % 7 = 6"))


def _src_crawl_audit(spark, d):
    return crawl_audit(_torn_crawls(spark, d), max_pages=18)


def _src_crawl_gaps(spark, d):
    # Few pages hold an order that dear; a tenth of the rest is lost as well.
    pages = _torn_crawls(spark, d).where("(CAST(substr(crawl_id, 7) AS INT) * 7 + page_no * page_no) % 10 != 1")
    return crawl_gaps(pages)


def _src_key_lookup(spark, d):
    return key_lookup(
        table(spark, d, "lineitem"), "l_orderkey IN (7, 1024, 5001)", "l_quantity > 5"
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


def _src_key_scan(spark, d):
    return key_lookup(table(spark, d, "lineitem"), filter="CASE WHEN l_discount = 0.1 THEN l_tax END", scan=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_tax"
    )


def _src_key_lookup_indexed(spark, d):
    """The lookup over a table that is laid out for it."""
    path = scratch_dir(spark, "lookup") + "/lineitem"
    write_lookup_table(table(spark, d, "lineitem"), path, "l_orderkey")
    return key_lookup(spark.read.parquet(path), "l_orderkey IN (7, 1024, 5001)", "l_quantity > 5").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


def _src_time_window(spark, d):
    end = datetime(2024, 1, 15, 12, 0, 0)
    last_hour = time_window(table(spark, d, "events"), "ts", end=end)
    first_day = time_window(table(spark, d, "events"), "ts", datetime(2024, 1, 1), datetime(2024, 1, 2))
    return last_hour.unionAll(first_day).select("event_id", "ts", "event_type")


def _texts(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS whole", "CAST(l_quantity AS STRING) AS amount",
        "CASE WHEN l_tax > 0.04 THEN CAST(l_linenumber AS STRING) ELSE CAST(l_discount AS STRING) END AS mixed_numbers",
        "CAST(l_shipdate AS STRING) AS moment", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS day",
        "CAST(l_discount > 0.05 AS STRING) AS flag",
        "CASE WHEN l_quantity > 49 THEN 'many' ELSE CAST(l_quantity AS STRING) END AS mixed",
        "l_returnflag AS letter",
        "CASE WHEN l_tax > 0.04 THEN CAST(l_linenumber AS STRING) END AS sparse",
        "CAST(1234567890123000000 + l_orderkey AS STRING) AS long_id", "lpad(CAST(l_linenumber AS STRING), 5, '0') AS padded",
    )


def _src_type_infer(spark, d):
    return infer_column_types(_texts(spark, d))


def _src_type_override(spark, d):
    good, bad = apply_column_types(_texts(spark, d).select("whole", "mixed"), {"whole": "int", "mixed": "float"})
    a = good.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.sum("mixed").alias("total"))
    b = bad.groupBy(F.col("whole").cast("long").alias("whole")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total")
    )
    return a.withColumn("refused", F.lit("")).unionAll(b.withColumn("refused", F.lit("mixed")))


def _payloads(spark, d):
    payload = F.expr(
        "CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN concat(props, ' x') "
        "WHEN 'click' THEN concat('[[[', props, ']]]') "
        "WHEN 'signup' THEN concat('{\"quote\": \"}]\\\\\" {{{[[\", \"p\": ', props, '}') ELSE props END"
    )
    return table(spark, d, "events").select("event_id", payload.alias("payload"))


def _json_quarantine(spark, d):
    judged = judge_bounded_json(_payloads(spark, d), "payload", max_depth=3)
    return judged.select("event_id", "payload", F.coalesce("reason", F.lit("")).alias("reason"))


QUERIES = {
    "src_csv": _src_csv,
    "src_csv_ragged": _src_csv_ragged,
    "src_ndjson": _src_ndjson,
    "src_ndjson_quarantine": _src_ndjson_quarantine,
    "src_json_doc": _src_json_doc,
    "src_infer_format": _src_infer_format,
    "src_list_objects": _src_list_objects,
    "src_text_typed": _src_text_typed,
    "src_sql_cte": _sql(["orders", "customer"], SQL_CTE),
    "src_sql_params": _sql(["orders"], SQL_PARAMS, [100000.0, 150000.0, "O"]),
    "src_sql_window": _sql(["orders"], SQL_WINDOW),
    "src_sql_rollup": _sql(["lineitem"], SQL_ROLLUP),
    "src_sql_setops": _sql(["customer", "supplier", "nation"], SQL_SETOPS),
    "src_sql_semi_anti": _sql(["customer", "orders"], SQL_SEMI_ANTI),
    "src_sql_subquery": _sql(["part"], SQL_SUBQUERY),
    "src_sql_distinct_agg": _sql(["lineitem"], SQL_DISTINCT),
    "src_api_items": _src_api_items,
    "src_graphql_edges": _src_graphql_edges,
    "src_graphql_errors": _src_graphql_errors,
    "src_next_page": _src_next_page,
    "src_crawl_audit": _src_crawl_audit,
    "src_crawl_gaps": _src_crawl_gaps,
    "src_ndjson_lines": _src_ndjson_lines,
    "src_key_lookup": _src_key_lookup,
    "src_key_lookup_indexed": _src_key_lookup_indexed,
    "src_key_scan": _src_key_scan,
    "src_time_window": _src_time_window,
    "src_type_infer": _src_type_infer,
    "src_type_override": _src_type_override,
    "json_quarantine": _json_quarantine,
}

_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_PAGES = """
    SELECT 'crawl-' || (o_orderkey // 1000) AS crawl_id, CAST((o_orderkey % 1000) // 50 AS INTEGER) AS page_no,
           count(*) AS items, max(o_totalprice) AS dearest
    FROM orders GROUP BY 1, 2"""
# A place in a page is shown unless its page is cut short or emptied.
_SHOWN = "NOT (crawl % 11 = 3 AND page_no = 4 AND place > 7) AND NOT (crawl % 13 = 4 AND page_no = 5)"
_REST = f"""
    SELECT crawl_id, page_no, dearest, page_no = 19 AND crawl % 17 = 5 AS broken,
           CASE WHEN crawl % 11 = 3 AND page_no = 4 THEN least(items, 7) WHEN crawl % 13 = 4 AND page_no = 5 THEN 0 ELSE items END AS items
    FROM (SELECT *, CAST(substr(crawl_id, 7) AS INTEGER) AS crawl FROM ({_PAGES}))"""
_TYPE_TEXTS = """
    SELECT CAST(l_orderkey AS VARCHAR) AS whole, CAST(l_quantity AS VARCHAR) AS amount,
           CASE WHEN l_tax > 0.04 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END AS mixed_numbers,
           CAST(l_shipdate AS VARCHAR) AS moment, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
           CAST(l_discount > 0.05 AS VARCHAR) AS flag,
           CASE WHEN l_quantity > 49 THEN 'many' ELSE CAST(l_quantity AS VARCHAR) END AS mixed,
           l_returnflag AS letter, CASE WHEN l_tax > 0.04 THEN CAST(l_linenumber AS VARCHAR) END AS sparse,
           CAST(1234567890123000000 + l_orderkey AS VARCHAR) AS long_id, lpad(CAST(l_linenumber AS VARCHAR), 5, '0') AS padded
    FROM lineitem"""
_INFER = " UNION ALL ".join(
    f"""
    SELECT '{c}' AS name,
           CASE WHEN count({c}) = count(*) FILTER (WHERE regexp_full_match({c}, '-?[0-9]+') AND NOT starts_with({c}, '00')) THEN 'int'
                WHEN count(*) FILTER (WHERE starts_with({c}, '00')) > 0 THEN 'string'
                WHEN count({c}) = count(TRY_CAST({c} AS DOUBLE)) THEN 'float'
                WHEN count({c}) = count(*) FILTER (WHERE {c} IN ('true', 'false')) THEN 'bool'
                WHEN count({c}) = count(*) FILTER (WHERE strlen({c}) = 10 AND TRY_CAST({c} AS DATE) IS NOT NULL) THEN 'date'
                WHEN count({c}) = count(TRY_CAST({c} AS TIMESTAMP)) THEN 'datetime'
                ELSE 'string' END AS type,
           count({c}) AS non_null
    FROM ({_TYPE_TEXTS})"""
    for c in ("whole", "amount", "mixed_numbers", "moment", "day", "flag", "mixed", "letter", "sparse", "long_id", "padded")
)

ORACLE = {
    "src_csv": f"""
        SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
               {_NUMBER.format('p_retailprice')} AS p_retailprice FROM part""",
    "src_csv_ragged": """
        SELECT CAST(s_suppkey AS VARCHAR) AS key,
               CASE WHEN s_acctbal < 2000 THEN NULL WHEN s_acctbal < 4000 THEN '' WHEN s_acctbal < 6000 THEN s_name
                    ELSE s_name || ';' END AS name,
               CASE WHEN s_acctbal < 2000 THEN NULL WHEN s_acctbal < 4000 THEN ''
                    ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""",
    "src_ndjson": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority FROM orders""",
    "src_ndjson_quarantine": """
        SELECT event_type = 'error' AS broken,
               CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, count(*) AS n
        FROM events WHERE event_type <> 'view' GROUP BY 1, 2""",
    "src_json_doc": """
        SELECT c_custkey, c_name, c_acctbal FROM customer
        UNION ALL SELECT -r_regionkey - 1, NULL, NULL FROM region UNION ALL SELECT NULL, NULL, NULL FROM region""",
    "src_ndjson_lines": """
        SELECT CAST(part AS INTEGER) AS part, line, text FROM (
            SELECT event_id % 3 AS part, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS line, event_type,
                   CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'signup' THEN CAST(event_id AS VARCHAR) END AS text
            FROM events) WHERE text IS NOT NULL""",
    "src_list_objects": """
        SELECT c_mktsegment AS segment, 'parquet' AS kind, CAST(1 AS BIGINT) AS objects, true AS filled, true AS dated
        FROM customer GROUP BY 1""",
    "src_infer_format": """
        SELECT page_id, CASE WHEN length(html) > 4000 THEN 'csv' WHEN length(html) > 2000 THEN 'ndjson' ELSE 'json' END
               AS format FROM pages""",
    "src_text_typed": """
        SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
               CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment, c_name AS raw FROM customer""",
    "src_sql_cte": SQL_CTE,
    "src_sql_params": SQL_PARAMS.replace("?", "100000", 1).replace("?", "150000", 1).replace("?", "'O'", 1),
    "src_sql_window": SQL_WINDOW,
    "src_sql_rollup": SQL_ROLLUP,
    "src_sql_setops": SQL_SETOPS,
    "src_sql_semi_anti": SQL_SEMI_ANTI,
    "src_sql_subquery": SQL_SUBQUERY,
    "src_sql_distinct_agg": SQL_DISTINCT,
    "src_api_items": f"""
        SELECT crawl_id, page_no, id, status, price FROM (
            SELECT 'crawl-' || (o_orderkey // 1000) AS crawl_id, (o_orderkey // 1000) AS crawl,
                   CAST((o_orderkey % 1000) // 50 AS INTEGER) AS page_no, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price,
                   row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS place FROM orders)
        WHERE {_SHOWN} AND NOT (crawl % 17 = 5 AND page_no = 19)""",
    "src_graphql_edges": f"""
        SELECT p.crawl_id, p.page_no, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price
        FROM orders JOIN ({_PAGES}) p
          ON p.crawl_id = 'crawl-' || (o_orderkey // 1000) AND p.page_no = (o_orderkey % 1000) // 50
        WHERE p.dearest <= 499000""",
    "src_graphql_errors": f"""
        SELECT crawl_id, page_no, 'item too dear on page ' || page_no AS error FROM ({_PAGES}) WHERE dearest > 499000""",
    "src_next_page": f"""
        SELECT 'offset' AS strategy, crawl_id, page_no,
               CASE WHEN items >= 50 AND NOT broken THEN CAST((page_no + 1) * 50 AS VARCHAR) END AS next_token, broken FROM ({_REST})
        UNION ALL SELECT 'page', crawl_id, page_no, CASE WHEN items > 0 AND NOT broken THEN CAST(page_no + 2 AS VARCHAR) END, broken FROM ({_REST})
        UNION ALL SELECT 'cursor', crawl_id, page_no, CASE WHEN page_no < 19 THEN CAST(page_no + 1 AS VARCHAR) END, broken
                  FROM ({_REST})
        UNION ALL SELECT 'link', crawl_id, page_no,
                  CASE WHEN page_no < 19 THEN 'https://api.test/x?ids=1,2&page=' || (page_no + 1) END, false FROM ({_REST})
        UNION ALL SELECT 'relay', crawl_id, page_no,
                  CASE WHEN page_no < 19 AND dearest <= 499000 THEN 'c' || page_no END, false FROM ({_PAGES})""",
    "src_crawl_audit": f"""
        SELECT crawl_id, count(*) AS pages, max(page_no) + 1 - count(*) AS missing_pages, count(*) FILTER (WHERE broken) AS failed_pages,
               count(*) FILTER (WHERE page_no % 7 = 6) AS repeated_pages, nullif(arg_max(token, page_no), '') AS last_token,
               count(*) >= 18 AND arg_max(token, page_no) <> '' AS truncated,
               max(page_no) + 1 = count(*) AND NOT bool_or(broken) AND arg_max(token, page_no) = '' AS complete
        FROM (SELECT *, CASE WHEN items >= 50 AND NOT broken THEN CAST((page_no + 1) * 50 AS VARCHAR) ELSE '' END AS token FROM ({_REST}))
        WHERE dearest <= 499500 GROUP BY 1""",
    "src_crawl_gaps": f"""
        SELECT crawl_id, before + 1 AS first, page_no - 1 AS last, page_no - 1 - before AS missing FROM (
            SELECT crawl_id, CAST(page_no AS BIGINT) AS page_no, coalesce(lag(page_no) OVER (PARTITION BY crawl_id ORDER BY page_no), -1) AS before FROM ({_PAGES})
            WHERE dearest <= 499500 AND (CAST(substr(crawl_id, 7) AS INTEGER) * 7 + page_no * page_no) % 10 <> 1)
        WHERE page_no - 1 > before""",
    "src_key_lookup": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem
        WHERE l_orderkey IN (7, 1024, 5001) AND l_quantity > 5""",
    "src_key_lookup_indexed": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem
        WHERE l_orderkey IN (7, 1024, 5001) AND l_quantity > 5""",
    "src_key_scan": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_tax FROM lineitem WHERE l_discount = 0.1 AND l_tax <> 0""",
    "src_time_window": """
        SELECT event_id, ts, event_type FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'
        UNION ALL SELECT event_id, ts, event_type FROM events
        WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02'""",
    "src_type_infer": _INFER,
    "src_type_override": """
        SELECT l_orderkey AS whole, count(*) AS n, sum(CASE WHEN l_quantity <= 49 THEN l_quantity END) AS total,
               CASE WHEN l_quantity > 49 THEN 'mixed' ELSE '' END AS refused
        FROM lineitem GROUP BY l_orderkey, CASE WHEN l_quantity > 49 THEN 'mixed' ELSE '' END""",
    "json_quarantine": """
        SELECT event_id,
               CASE event_type WHEN 'error' THEN left(props, length(props) - 1) WHEN 'view' THEN props || ' x'
                    WHEN 'click' THEN '[[[' || props || ']]]'
                    WHEN 'signup' THEN '{"quote": "}]\\" {{{[[", "p": ' || props || '}' ELSE props END AS payload,
               CASE event_type WHEN 'error' THEN 'invalid json' WHEN 'view' THEN 'invalid json'
                    WHEN 'click' THEN 'json exceeds the maximum depth of 3' ELSE '' END AS reason
        FROM events""",
}
