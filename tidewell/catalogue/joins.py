"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.operators import concat, join


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


def _rich(spark, d):
    return _customers(spark, d).where("c_acctbal > 5000")


def _dear(spark, d):
    return _orders(spark, d).where("o_totalprice > 300000")


def _join_inner(spark, d):
    return join(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey")


def _join_left(spark, d):
    return join(_orders(spark, d), _rich(spark, d), "o_custkey", "c_custkey", "left")


def _join_left_split(spark, d):
    return join(_orders(spark, d), _rich(spark, d), "o_custkey", "c_custkey", "left", split_outer=True)


def _join_right(spark, d):
    return join(_dear(spark, d), _customers(spark, d), "o_custkey", "c_custkey", "right")


def _join_outer(spark, d):
    return join(_dear(spark, d), _rich(spark, d), "o_custkey", "c_custkey", "outer")


def _join_outer_split(spark, d):
    return join(_dear(spark, d), _rich(spark, d), "o_custkey", "c_custkey", "outer", split_outer=True)


def _join_null_safe(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", F.expr("nullif(s_nationkey, 3)").alias("s_nation"))
    nation = table(spark, d, "nation").select("n_name", F.expr("nullif(n_nationkey, 3)").alias("n_nation"))
    return join(supplier, nation, "s_nation", "n_nation")


def _join_prefix(spark, d):
    left = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price")
    )
    right = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")
    )
    return join(left, right, "id", "id", right_prefix="order_")


def _concat(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("amount")
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"), F.col("s_name").alias("title")
    )
    return concat(customers, None, suppliers)


def _concat_conflict(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tag"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tag"))
    return concat(orders, customers).select("id", F.to_json("tag").alias("tag"))


QUERIES = {
    "join_inner": _join_inner,
    "join_left": _join_left,
    "join_left_split": _join_left_split,
    "join_right": _join_right,
    "join_outer": _join_outer,
    "join_outer_split": _join_outer_split,
    "join_null_safe": _join_null_safe,
    "join_prefix": _join_prefix,
    "concat": _concat,
    "concat_conflict": _concat_conflict,
}

_RICH = "(SELECT * FROM customer WHERE c_acctbal > 5000)"
_DEAR = "(SELECT * FROM orders WHERE o_totalprice > 300000)"
_COLUMNS = "o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_acctbal"

ORACLE = {
    "join_inner": f"SELECT {_COLUMNS} FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left": f"SELECT {_COLUMNS} FROM orders LEFT JOIN {_RICH} c ON o_custkey = c_custkey",
    "join_left_split": f"SELECT {_COLUMNS} FROM orders LEFT JOIN {_RICH} c ON o_custkey = c_custkey",
    "join_right": f"SELECT {_COLUMNS} FROM {_DEAR} o RIGHT JOIN customer ON o_custkey = c_custkey",
    "join_outer": f"SELECT {_COLUMNS} FROM {_DEAR} o FULL JOIN {_RICH} c ON o_custkey = c_custkey",
    "join_outer_split": f"SELECT {_COLUMNS} FROM {_DEAR} o FULL JOIN {_RICH} c ON o_custkey = c_custkey",
    "join_null_safe": """
        SELECT s_suppkey, s_nation, n_name, n_nation
        FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS s_nation FROM supplier) s
        JOIN (SELECT n_name, nullif(n_nationkey, 3) AS n_nation FROM nation) n
          ON s_nation IS NOT DISTINCT FROM n_nation""",
    "join_prefix": """
        SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, o_orderkey AS order_id,
               o_totalprice AS order_price, o_orderstatus AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "concat": """
        SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS DOUBLE) AS amount, NULL AS title FROM customer
        UNION ALL SELECT s_suppkey, NULL, s_acctbal, s_name FROM supplier""",
    "concat_conflict": """
        SELECT o_orderkey AS id, '"' || o_orderstatus || '"' AS tag FROM orders
        UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer""",
}
