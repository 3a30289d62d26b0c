"""Grouping and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.operators import Agg, group_by


def _rounded(df, places=4):
    return df.select(
        *[F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema]
    )


def _group_multi_key(spark, d):
    return _rounded(
        group_by(
            table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"],
            [Agg("sum", "l_extendedprice", "revenue"), Agg("avg", "l_discount", "disc"), Agg("count", "", "n")],
        )
    )


def _agg_sum(spark, d):
    orders = table(spark, d, "orders").withColumn("maybe", F.expr("CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END"))
    return _rounded(
        group_by(
            orders, ["o_orderstatus"],
            [Agg("sum", "o_totalprice", "total"), Agg("sum", "maybe", "maybe_total"), Agg("sum", "o_orderpriority", "text_total")],
        ), 2,
    )


def _agg_avg(spark, d):
    events = table(spark, d, "events").withColumn("maybe", F.expr("CASE WHEN event_type <> 'view' THEN value END"))
    return _rounded(group_by(events, ["event_type"], [Agg("avg", "value", "mean"), Agg("avg", "maybe", "maybe_mean")]))


def _agg_count(spark, d):
    customers = table(spark, d, "customer").withColumn("maybe", F.expr("CASE WHEN c_acctbal > 0 THEN 1 END"))
    return group_by(customers, ["c_nationkey"], [Agg("count", "maybe", "n")])


def _agg_min_max(spark, d):
    parts = table(spark, d, "part").withColumn("maybe", F.expr("CASE WHEN p_size > 10 THEN p_size END"))
    return group_by(
        parts, ["p_brand"],
        [Agg("min", "p_retailprice", "low"), Agg("max", "p_retailprice", "high"), Agg("min", "maybe", "maybe_low"),
         Agg("max", "p_type", "text_high")],
    )


def _agg_default_names(spark, d):
    return _rounded(
        group_by(
            table(spark, d, "supplier"), ["s_nationkey"],
            [Agg("sum", "s_acctbal"), Agg("avg", "s_acctbal"), Agg("count", "s_suppkey"), Agg("max", "s_acctbal")],
        )
    )


def _group_ordered(spark, d):
    sizes = table(spark, d, "part").withColumn("size", F.expr("nullif(p_size, 7)"))
    return group_by(sizes, ["size"], [Agg("count", "", "n")], ordered=True)


def _agg_global(spark, d):
    some = group_by(table(spark, d, "orders"), [], [Agg("sum", "o_totalprice", "total"), Agg("count", "", "n")])
    none = group_by(
        table(spark, d, "orders").where("o_totalprice < 0"), [], [Agg("sum", "o_totalprice", "total"), Agg("count", "", "n")]
    )
    return _rounded(some.unionAll(none), 2)


QUERIES = {
    "group_multi_key": _group_multi_key,
    "agg_sum": _agg_sum,
    "agg_avg": _agg_avg,
    "agg_count": _agg_count,
    "agg_min_max": _agg_min_max,
    "agg_default_names": _agg_default_names,
    "group_ordered": _group_ordered,
    "agg_global": _agg_global,
}

ORACLE = {
    "group_multi_key": """
        SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_extendedprice), 4) AS revenue,
               round(avg(l_discount), 4) AS disc, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
    "agg_sum": """
        SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total,
               round(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END), 0), 2) AS maybe_total,
               CAST(0 AS DOUBLE) AS text_total FROM orders GROUP BY 1""",
    "agg_avg": """
        SELECT event_type, round(avg(value), 4) AS mean,
               round(coalesce(avg(CASE WHEN event_type <> 'view' THEN value END), 0), 4) AS maybe_mean
        FROM events GROUP BY 1""",
    "agg_count": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1",
    "agg_min_max": """
        SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high,
               CAST(coalesce(min(CASE WHEN p_size > 10 THEN p_size END), 0) AS DOUBLE) AS maybe_low,
               CAST(0 AS DOUBLE) AS text_high FROM part GROUP BY 1""",
    "agg_default_names": """
        SELECT s_nationkey, round(sum(s_acctbal), 4) AS sum_s_acctbal, round(avg(s_acctbal), 4) AS avg_s_acctbal,
               count(*) AS count_s_suppkey, round(max(s_acctbal), 4) AS max_s_acctbal FROM supplier GROUP BY 1""",
    "group_ordered": "SELECT nullif(p_size, 7) AS size, count(*) AS n FROM part GROUP BY 1 ORDER BY CAST(size AS VARCHAR) NULLS FIRST",
    "agg_global": "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders",
}
