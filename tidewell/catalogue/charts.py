"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.charts import chart_data, downsample, heatmap, scatter, sparkline, stacked_share
from tidewell.functions.chart import ChartConfig, default_chart


def _chart_data(spark, d):
    orders = table(spark, d, "orders").withColumn("label", F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    chosen = chart_data(orders, ChartConfig("line", "o_orderdate", ("o_totalprice", "label")), ["o_orderdate", "o_orderkey"])
    return chosen.select("o_orderdate", "o_totalprice", "label")


def _chart_default(spark, d):
    parts = table(spark, d, "part").select("p_name", "p_size", "p_retailprice", "p_partkey")
    return chart_data(parts, default_chart(parts), ["p_partkey"], 200)


def _chart_heatmap(spark, d):
    cells = heatmap(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity")
    return cells.withColumn("value", F.round("value", 2))


def _chart_share(spark, d):
    shares = stacked_share(
        table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderpriority", "o_totalprice"
    )
    return shares.select("year", "o_orderpriority", F.round("value", 2).alias("value"), F.round("share", 8).alias("share"))


def _chart_scatter(spark, d):
    parts = table(spark, d, "part").withColumn("maybe", F.expr("CASE WHEN p_size > 20 THEN p_size END"))
    return scatter(parts, "maybe", "p_retailprice", "p_brand")


def _chart_sparkline(spark, d):
    lines = sparkline(table(spark, d, "events"), "user_id", "ts", "value")
    text = F.array_join(F.transform("points", lambda p: F.round(p, 2).cast("string")), ",")
    return lines.select("user_id", text.alias("points"), "n")


def _downsample_minmax(spark, d):
    return downsample(table(spark, d, "events"), "ts", "value", 40, ["event_type"])


QUERIES = {
    "chart_data": _chart_data,
    "chart_default": _chart_default,
    "chart_heatmap": _chart_heatmap,
    "chart_share": _chart_share,
    "chart_scatter": _chart_scatter,
    "chart_sparkline": _chart_sparkline,
    "downsample_minmax": _downsample_minmax,
}

ORACLE = {
    "chart_data": """
        SELECT o_orderdate, o_totalprice, CAST(o_custkey AS DOUBLE) AS label FROM orders
        ORDER BY o_orderdate, o_orderkey LIMIT 50""",
    "chart_default": """
        SELECT p_name, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part ORDER BY p_partkey LIMIT 200""",
    "chart_heatmap": """
        SELECT l_returnflag, l_linenumber, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2""",
    "chart_share": """
        SELECT year, o_orderpriority, round(v, 2) AS value, round(v / sum(v) OVER (PARTITION BY year), 8) AS share
        FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, sum(o_totalprice) AS v
              FROM orders GROUP BY 1, 2)""",
    "chart_scatter": """
        SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand FROM part WHERE p_size > 20""",
    "chart_sparkline": """
        SELECT user_id, string_agg(CAST(round(v, 2) AS VARCHAR), ',' ORDER BY day) AS points, count(*) AS n
        FROM (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1""",
    "downsample_minmax": """
        WITH b AS (SELECT event_type, ts, value, (epoch_us(ts) - lo) * 40 // (hi - lo + 1) AS bin
                   FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)),
             r AS (SELECT *, row_number() OVER (PARTITION BY event_type, bin ORDER BY value, ts) AS low,
                          row_number() OVER (PARTITION BY event_type, bin ORDER BY value DESC, ts DESC) AS high FROM b)
        SELECT event_type, bin, ts, value FROM r WHERE low = 1 OR high = 1""",
}
