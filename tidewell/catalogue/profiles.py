"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import table
from tidewell.operators.profile import describe, dictionary_encode, distinct_counts, histogram, low_cardinality
from tidewell.operators.sketches import merge_states, profile_of, profile_state
from tidewell.session import scratch_dir


def _described(spark, d):
    events = table(spark, d, "events")
    return events.withColumn("maybe", F.expr("CASE WHEN event_type = 'error' THEN value END")).withColumn(
        "flag", F.col("value") > 10
    )


def _describe(spark, d):
    return describe(_described(spark, d)).withColumn("mean", F.round("mean", 4))


def _low_cardinality(spark, d):
    return low_cardinality(table(spark, d, "documents"))


def _dict_encode(spark, d):
    return dictionary_encode(table(spark, d, "lineitem"))[0].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )


def _dictionary(spark, d):
    return dictionary_encode(table(spark, d, "orders"))[1]


def _profile_distinct(spark, d):
    return distinct_counts(table(spark, d, "lineitem"))


def _histogram(spark, d):
    return histogram(
        table(spark, d, "lineitem").withColumn("maybe", F.expr("CASE WHEN l_tax > 0.03 THEN l_extendedprice END")),
        ["l_quantity", "l_extendedprice", "maybe"],
    ).select("name", "bucket", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n", "nulls")


_MERGED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


def _profile_merge(spark, d):
    """A table that came in three appends, profiled one by one, the states merged: exact numbers, and whether the estimates keep to their error."""
    lines = table(spark, d, "lineitem").select(*_MERGED).withColumn("maybe", F.expr("CASE WHEN l_quantity > 40 THEN l_extendedprice END"))
    path = scratch_dir(spark, "states") + "/lineitem"
    for part in range(3):
        profile_state(lines.where(f"l_orderkey % 3 = {part}")).write.mode("append").parquet(path)
    found = profile_of(merge_states(spark.read.parquet(path)))
    distinct = F.inline(F.array(*[F.struct(F.lit(c).alias("of"), F.col(f"`{c}`").alias("exact")) for c in lines.columns]))
    exact = lines.agg(*[F.count_distinct(c).alias(c) for c in lines.columns]).select(distinct)
    medians = found.where("median IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("m")).scalar()
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("in"), F.col(c).cast("double").alias("v")) for c in ("l_orderkey", "l_quantity", "l_extendedprice", "maybe")]))
    ranks = lines.select(cells).where("v IS NOT NULL").withColumn("m", F.element_at(medians, F.col("in")))
    ranks = ranks.groupBy("in").agg((F.avg((F.col("v") < F.col("m")).cast("int")) < 0.53).alias("low"), (F.avg((F.col("v") <= F.col("m")).cast("int")) > 0.47).alias("high"))
    both = found.join(exact, F.col("name") == F.col("of")).join(ranks, F.col("name") == F.col("in"), "left")
    return both.select(
        "name", "type", "count", "null_count", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"),
        (F.abs(F.col("distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_near"), (F.col("low") & F.col("high")).alias("median_near"),
    )


QUERIES = {
    "profile_merge": _profile_merge,
    "describe": _describe,
    "low_cardinality": _low_cardinality,
    "dict_encode": _dict_encode,
    "dict_table": _dictionary,
    "profile_distinct": _profile_distinct,
    "histogram": _histogram,
}


def _numeric(name, kind, value):
    return f"""
        SELECT '{name}' AS name, '{kind}' AS type, count({value}) AS count, count(*) - count({value}) AS null_count,
               CAST(min({value}) AS DOUBLE) AS min, CAST(max({value}) AS DOUBLE) AS max,
               round(avg({value}), 4) AS mean, CAST(NULL AS BIGINT) AS min_len, CAST(NULL AS BIGINT) AS max_len
        FROM events"""


def _text(name):
    return f"""
        SELECT '{name}', 'string', count({name}), count(*) - count({name}), NULL, NULL, NULL,
               min(strlen({name})), max(strlen({name})) FROM events"""


def _other(name, kind, value):
    return f"SELECT '{name}', '{kind}', count({value}), count(*) - count({value}), NULL, NULL, NULL, NULL, NULL FROM events"


def _buckets(name, value):
    return f"""
        SELECT '{name}' AS name, CAST(b AS INTEGER) AS bucket, round(lo + (b - 1) * (hi - lo) / 10, 4) AS low,
               round(lo + b * (hi - lo) / 10, 4) AS high, count(v) AS n, any_value(nulls) AS nulls
        FROM (SELECT min({value}) AS lo, max({value}) AS hi, count(*) - count({value}) AS nulls FROM lineitem) r
        CROSS JOIN range(1, 11) t(b)
        LEFT JOIN (SELECT {value} AS v, least(floor(({value} - l) * 10 / (h - l)) + 1, 10) AS k
                   FROM lineitem, (SELECT min({value}) AS l, max({value}) AS h FROM lineitem)) x ON x.k = b
        GROUP BY b, lo, hi"""


_MAYBE = "(CASE WHEN l_tax > 0.03 THEN l_extendedprice END)"
_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)

def _merged(name, kind, value, numeric=True):
    numbers = f"round(CAST(min({value}) AS DOUBLE), 4), round(CAST(max({value}) AS DOUBLE), 4), round(avg(CAST({value} AS DOUBLE)), 4), true, true"
    return f"""SELECT '{name}', '{kind}', count({value}), count(*) - count({value}), {numbers if numeric else "NULL, NULL, NULL, true, NULL"} FROM lineitem"""


ORACLE = {
    "profile_merge": 'SELECT * FROM (' + " UNION ALL ".join(
        [
            _merged("l_orderkey", "int64", "l_orderkey"), _merged("l_quantity", "float64", "l_quantity"), _merged("l_extendedprice", "float64", "l_extendedprice"),
            _merged("l_returnflag", "string", "l_returnflag", False), _merged("l_shipdate", "time", "l_shipdate", False),
            _merged("maybe", "float64", "CASE WHEN l_quantity > 40 THEN l_extendedprice END"),
        ]
    ) + ") t(name, type, count, null_count, min, max, mean, distinct_near, median_near)",
    "describe": " UNION ALL ".join(
        [
            _numeric("event_id", "int64", "event_id"), _other("ts", "time", "ts"),
            _numeric("user_id", "int64", "user_id"), _text("event_type"), _numeric("value", "float64", "value"),
            _text("props"), _numeric("maybe", "float64", "CASE WHEN event_type = 'error' THEN value END"),
            _other("flag", "bool", "value > 10"),
        ]
    ),
    "low_cardinality": " UNION ALL ".join(
        f"""
        SELECT '{c}' AS name, count(DISTINCT {c}) AS "distinct" FROM documents
        HAVING count(DISTINCT {c}) BETWEEN 1 AND 128"""
        for c in ("text", "lang", "source")
    ),
    "dict_encode": """
        SELECT l_orderkey, l_linenumber, l_partkey, r.code AS l_returnflag, s.code AS l_linestatus FROM lineitem
        JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)) r
          ON r.v = l_returnflag
        JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem)) s
          ON s.v = l_linestatus""",
    "dict_table": " UNION ALL ".join(
        f"""
        SELECT '{c}' AS name, v AS value, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT {c} AS v FROM orders)"""
        for c in ("o_orderpriority", "o_orderstatus")
    ),
    "profile_distinct": " UNION ALL ".join(
        f"""SELECT '{c}' AS name, least(count(DISTINCT {c}), 10000) AS "distinct", count(DISTINCT {c}) > 10000 AS capped FROM lineitem""" for c in _COLUMNS
    ),
    "histogram": " UNION ALL ".join(
        [_buckets("l_quantity", "l_quantity"), _buckets("l_extendedprice", "l_extendedprice"), _buckets("maybe", _MAYBE)]
    ),
}
