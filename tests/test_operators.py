"""Small hand-made tables: the operators' rules and their edge cases."""

import pytest
from pyspark.sql import functions as F, types as T

from tidewell.frame import Frame, Meta, UnknownColumnError, logical_type, widen
from tidewell.operators import (
    Agg, concat, count_long_cells, filter_rows, group_by, head, join, limit_columns, rename, row_limit,
    select_existing, transform, truncate_cells, truthy,
)
from tidewell.operators.cells import cell_warning
from tidewell.operators.limits import effective_row_limit, page, page_size
from tidewell.operators.history import text_search, trailing_usage
from tidewell.operators.profile import describe, dictionary_encode, distinct_counts, histogram, low_cardinality
from tidewell.operators.sketches import merge_states, profile_of, profile_state
from tidewell.operators.textindex import text_search_indexed, write_text_index
from tidewell.session import scratch_dir
from tidewell.sources import key_lookup, write_lookup_table


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "alice"), (2, "bob")], "id long, name string")


def test_join_inner(spark, people, rows):
    roles = spark.createDataFrame([(1, "admin")], "user_id long, role string")
    assert rows(join(people, roles, "id", "user_id")) == [{"id": 1, "name": "alice", "user_id": 1, "role": "admin"}]


@pytest.mark.parametrize("split", [False, True])
def test_join_left_keeps_unmatched(spark, people, rows, split):
    roles = spark.createDataFrame([(1, "admin")], "user_id long, role string")
    got = rows(join(people, roles, "id", "user_id", "left", split_outer=split), "id")
    assert [r["role"] for r in got] == ["admin", None]


def test_join_collision_prefix(spark, people):
    other = spark.createDataFrame([(1, "x")], "id long, name string")
    assert join(people, other, "id", "id").columns == ["id", "name", "right_id", "right_name"]
    assert join(people, other, "id", "id", right_prefix="b_").columns == ["id", "name", "b_id", "b_name"]


def test_join_with_itself(people, rows):
    got = rows(join(people, people, "id", "id", "outer", split_outer=True), "id")
    assert [(r["id"], r["right_name"]) for r in got] == [(1, "alice"), (2, "bob")]


def test_join_prefix_taken(spark, people):
    left = people.withColumn("right_id", F.lit(1))
    with pytest.raises(ValueError, match="exists on both sides"):
        join(left, people, "id", "id")


def test_join_errors(spark, people):
    with pytest.raises(UnknownColumnError, match="nope"):
        join(people, people, "nope", "id")
    with pytest.raises(ValueError, match="left and a right key"):
        join(people, people, "", "id")
    with pytest.raises(ValueError, match="unknown join type"):
        join(people, people, "id", "id", "sideways")
    with pytest.raises(TypeError, match="unlike types"):
        join(people, people, "id", "name")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_split_join_equals_plain_join(spark, how):
    """Null keys, duplicate keys on both sides, rows without partner."""
    left = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, None), (5, 7), (6, 8)], "a long, k int")
    right = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 9), (5, 7), (6, 7)], "b long, j long")
    plain = left.join(right, F.col("k").eqNullSafe(F.col("j")), how)
    for split in (False, True):
        got = join(left, right, "k", "j", how, split_outer=split)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_group_by(spark, rows):
    df = spark.createDataFrame([("east", 100), ("east", 50), ("west", 7)], "region string, amount long")
    got = rows(group_by(df, ["region"], [Agg("sum", "amount", "total"), Agg("count", "amount", "n")], ordered=True))
    assert got == [{"region": "east", "total": 150.0, "n": 2}, {"region": "west", "total": 7.0, "n": 1}]
    assert dict(group_by(df, ["region"], [Agg("sum", "amount"), Agg("count", "")]).dtypes) == {
        "region": "string", "sum_amount": "double", "count_": "bigint",
    }


def test_group_without_numbers_is_zero(spark, rows):
    df = spark.createDataFrame([("a", None, "x"), ("a", None, "y")], "k string, v double, t string")
    aggs = [Agg(op, f) for op in ("sum", "avg", "min", "max") for f in ("v", "t")]
    (row,) = rows(group_by(df, ["k"], aggs))
    assert {v for k, v in row.items() if k != "k"} == {0.0}


def test_group_min_max_ignore_nan_and_take_decimals(spark, rows):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (1.0,)], "v double").withColumn(
        "d", F.expr("CAST(1.25 AS DECIMAL(5, 2))")
    )
    (row,) = rows(group_by(df, [], [Agg("min", "v"), Agg("max", "v"), Agg("sum", "d")]))
    assert row == {"min_v": 1.0, "max_v": 2.0, "sum_d": 3.75}


def test_group_order_is_textual_with_null_first(spark, rows):
    df = spark.createDataFrame([(9,), (10,), (None,), (1,)], "k int")
    assert [r["k"] for r in rows(group_by(df, ["k"], [Agg("count")], ordered=True))] == [None, 1, 10, 9]


def test_group_null_and_variant_keys(spark, rows):
    df = spark.createDataFrame([(None, '{"a":1}'), (None, '{"a":1}'), ("x", "2")], "k string, j string")
    got = rows(group_by(df.withColumn("j", F.parse_json("j")), ["k", "j"], [Agg("count", "", "n")]), "n")
    assert got == [{"k": "x", "j": "2", "n": 1}, {"k": None, "j": '{"a":1}', "n": 2}]


def test_group_of_no_rows(spark):
    empty = spark.createDataFrame([], "v long")
    assert group_by(empty, [], [Agg("sum", "v")]).count() == 0


def test_group_errors(spark, people):
    with pytest.raises(UnknownColumnError):
        group_by(people, ["nope"], [Agg("count")])
    with pytest.raises(UnknownColumnError):
        group_by(people, ["id"], [Agg("sum", "nope")])
    with pytest.raises(ValueError, match="repeat"):
        group_by(people, ["id"], [Agg("sum", "id", "x"), Agg("max", "id", "x")])
    with pytest.raises(ValueError, match="unknown aggregate"):
        group_by(people, ["id"], [Agg("median", "id")])


def test_select_and_rename(spark, rows):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert select_existing(df, ["b", "zzz"]).columns == ["b"]
    assert rename(df, {"a": "alpha", "zzz": "y"}).columns == ["alpha", "b"]
    with pytest.raises(ValueError, match="repeat"):
        rename(df, {"a": "b"})


def test_filter(spark):
    df = spark.createDataFrame([(150,), (40,), (200,), (None,)], "amount long")
    assert filter_rows(df, "amount > 100").count() == 2
    with pytest.raises(ValueError, match="needs an expression"):
        filter_rows(df, "  ")


def test_truthy_of_every_kind(spark, rows):
    df = spark.sql(
        "SELECT true b, 0.0D z, 2 i, '' s, array() a, array(0) a1, timestamp '2024-01-01' t, CAST(NULL AS STRING) n, "
        "named_struct('x', CAST(NULL AS INT)) st, parse_json('0') v"
    )
    flags = df.select(*[truthy(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns])
    assert rows(flags) == [
        {"b": True, "z": False, "i": True, "s": False, "a": False, "a1": True, "t": True, "n": False, "st": True, "v": True}
    ]


def test_transform_shapes(spark, people, rows):
    assert transform(people, {"who": "name"}).columns == ["who"]
    assert rows(transform(people, "id + 1"), "value") == [{"value": 2}, {"value": 3}]
    assert rows(transform(people, "array(id)"), "value")[0] == {"value": [1]}
    empty_rows = transform(people, "CASE WHEN id = 1 THEN named_struct('who', name, 'n', id) END")
    assert rows(empty_rows, "n") == [{"who": None, "n": None}, {"who": "alice", "n": 1}]


def test_concat(spark, rows):
    a = spark.createDataFrame([(1,)], "x long")
    b = spark.createDataFrame([(2.5, "t")], "x double, y string")
    got = concat(a, None, b)
    assert dict(got.dtypes) == {"x": "double", "y": "string"}
    assert rows(got, "x") == [{"x": 1.0, "y": None}, {"x": 2.5, "y": "t"}]


def test_concat_conflict_keeps_raw_values(spark, rows):
    a = spark.createDataFrame([(1,)], "x long")
    b = spark.createDataFrame([("t",), (None,)], "x string")
    c = spark.createDataFrame([((7,),)], "x struct<k: int>")
    got = concat(a, b, c)
    assert dict(got.dtypes) == {"x": "variant"}
    assert sorted(r["x"] or "" for r in rows(got.select(F.to_json("x").alias("x")))) == ["", '"t"', "1", '{"k":7}']


@pytest.mark.parametrize(
    "a, b, want",
    [
        (T.StringType(), T.StringType(), T.StringType()), (T.NullType(), T.LongType(), T.LongType()),
        (T.LongType(), T.NullType(), T.LongType()), (T.LongType(), T.DoubleType(), T.DoubleType()),
        (T.StringType(), T.BooleanType(), T.VariantType()), (T.LongType(), T.StringType(), T.VariantType()),
        (T.IntegerType(), T.LongType(), T.LongType()),
    ],
)
def test_widen(a, b, want):
    assert widen(a, b) == want == widen(b, a)


def test_logical_types():
    kinds = {
        T.StringType(): "string", T.IntegerType(): "int64", T.DoubleType(): "float64", T.BooleanType(): "bool",
        T.TimestampNTZType(): "time", T.NullType(): "null", T.VariantType(): "json", T.DecimalType(5, 2): "float64",
    }
    assert all(logical_type(t) == name for t, name in kinds.items())


def test_describe(spark, rows):
    df = spark.createDataFrame([(10, "ab"), (20, "abcd"), (None, "ä")], "amount long, name string")
    number, text = rows(describe(df))
    assert number == {
        "name": "amount", "type": "int64", "count": 2, "null_count": 1, "min": 10.0, "max": 20.0, "mean": 15.0,
        "min_len": None, "max_len": None,
    }
    assert (text["min_len"], text["max_len"], text["min"], text["null_count"]) == (2, 4, None, 0)


def test_describe_ignores_nan(spark, rows):
    (got,) = rows(describe(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")))
    assert (got["count"], got["min"], got["max"], got["mean"]) == (3, 1.0, 3.0, 2.0)


def test_truncate_cells(spark, rows):
    df = spark.createDataFrame([("0123456789", bytearray(b"abcdef")), ("ok", None)], "blob string, raw binary")
    got = rows(truncate_cells(df, 5, 4), "blob")
    assert got[0] == {"blob": "01234…(truncated)", "raw": bytearray(b"abcd")}
    assert got[1] == {"blob": "ok", "raw": None}
    assert rows(count_long_cells(df, 5, 4)) == [{"affected": 2}]
    assert cell_warning(2) == "2 cell(s) exceeded per-type cell limits and were truncated"
    # A limit of 0 switches a cut off.
    assert rows(truncate_cells(df, 0, 0), "blob")[0]["blob"] == "0123456789"


@pytest.mark.parametrize("limit", range(1, 9))
def test_truncate_never_splits_a_character(spark, rows, limit):
    text = "aé€😀z"
    (row,) = rows(truncate_cells(spark.createDataFrame([(text,)], "t string"), limit))
    kept = row["t"].removesuffix("…(truncated)")
    assert text.startswith(kept) and len(kept.encode()) <= limit
    assert len(text[: len(kept) + 1].encode()) > limit


def test_limit_columns(people):
    frame = limit_columns(Frame(people, Meta(name="p")), 1)
    assert frame.df.columns == ["id"] and frame.meta.truncated
    assert frame.meta.warnings == ("Column cap reached at 1 columns.",)
    assert limit_columns(Frame(people), 5).meta.truncated is False


def test_row_limits(spark):
    assert [effective_row_limit(n) for n in (0, -1, 5, 10_000)] == [1000, 1000, 5, 10_000]
    assert [page_size(n) for n in (None, 0, 200)] == [50, 50, 200]
    assert effective_row_limit(50_000, maximum=100_000) == 50_000 and page_size(5_000, maximum=5_000) == 5_000
    for refused in (lambda: effective_row_limit(20_000), lambda: page_size(201)):
        with pytest.raises(ValueError, match="above the maximum"):
            refused()
    frame = Frame(spark.range(10).toDF("n"))
    cut = row_limit(frame, 3, ["n"])
    assert cut.meta.truncated and [r[0] for r in cut.df.collect()] == [0, 1, 2]
    assert row_limit(frame, 10).meta.truncated is False
    assert head(frame.df, 0).count() == 10


def test_page_continues_exactly(spark):
    df = spark.range(30).select((F.col("id") % 4).alias("t"), "id")
    whole = [tuple(r) for r in df.orderBy(F.desc("t"), F.desc("id")).collect()]
    first = [tuple(r) for r in page(df, ["t", "id"], 12).collect()]
    second = [tuple(r) for r in page(df, ["t", "id"], 12, before=first[-1]).collect()]
    assert first + second == whole[:24]
    assert [tuple(r) for r in page(df, ["t", "id"], 12, offset=12).collect()] == second


def test_pages_go_on_over_nulls(spark):
    df = spark.createDataFrame([(5, 1), (4, 2), (None, 3), (None, 4), (None, None), (4, None)], "t int, id int")
    whole = [tuple(r) for r in df.orderBy(F.desc("t"), F.desc("id")).collect()]
    got, before = [], None
    while part := [tuple(r) for r in page(df, ["t", "id"], 2, before=before).collect()]:
        got, before = got + part, part[-1]
    assert got == whole


def test_low_cardinality_bounds(spark, rows):
    df = spark.range(400).select(
        (F.col("id") % 128).cast("string").alias("at_limit"), (F.col("id") % 129).cast("string").alias("above"),
        F.lit(None).cast("string").alias("nothing"), F.col("id").alias("number"),
    )
    assert rows(low_cardinality(df)) == [{"name": "at_limit", "distinct": 128}]


def test_dictionary_keeps_null(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    encoded, table = dictionary_encode(df)
    assert sorted(r["t"] if r["t"] is not None else -1 for r in rows(encoded)) == [-1, 0, 1, 1]
    assert {(r["value"], r["code"]) for r in rows(table)} == {("a", 0), ("b", 1)}


def test_distinct_counts(spark, rows):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 7).alias("m"), F.lit(None).cast("int").alias("none"))
    assert {r["name"]: r["capped"] for r in rows(distinct_counts(df, cap=50))} == {"id": True, "m": False, "none": False}
    objects = spark.sql("SELECT parse_json(concat('{\"k\": ', id % 3, '}')) AS v FROM range(9)")
    assert rows(distinct_counts(objects)) == [{"name": "v", "distinct": 3, "capped": False}]
    got = {r["name"]: r["distinct"] for r in rows(distinct_counts(df, cap=50))}
    assert got == {"id": 50, "m": 7, "none": 0}
    rough = {r["name"]: r["distinct"] for r in rows(distinct_counts(df, cap=50, exact=False))}
    assert rough["m"] == 7 and rough["none"] == 0


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (9.99, None), (float("nan"), 5.0)], "v double, same double")
    got = rows(histogram(df), "name", "bucket")
    v = {r["bucket"]: r["n"] for r in got if r["name"] == "v"}
    assert v[1] == 1 and v[10] == 2 and sum(v.values()) == 3
    assert {r["nulls"] for r in got} == {1}
    same = {r["bucket"]: r["n"] for r in got if r["name"] == "same"}
    assert same[1] == 3 and sum(same.values()) == 3


def test_merged_profiles_equal_one_pass(spark):
    """Whatever the cut into appends: exact numbers equal, estimates within their error, columns that come later, empty appends."""
    df = spark.range(30_000).selectExpr(
        "id", "CAST(id % 977 AS STRING) AS text", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 1000 = 1 THEN double('NaN') ELSE sqrt(id) END AS x", "CAST(NULL AS DOUBLE) AS none",
        "timestamp_seconds(id) AS t", "id % 2 = 0 AS flag",
    )
    parts = [df.where("id < 100"), df.where("id BETWEEN 100 AND 20000"), df.where("id > 20000"), df.where("false")]
    whole = {r["name"]: r for r in profile_of(profile_state(df)).collect()}
    merged = {r["name"]: r for r in profile_of(merge_states(*[profile_state(p) for p in parts])).collect()}
    again = {r["name"]: r for r in profile_of(merge_states(merge_states(*[profile_state(p) for p in parts[:2]]), *[profile_state(p) for p in parts[2:]])).collect()}
    exact = {r["name"]: r for r in describe(df).collect()}
    for name, one in whole.items():
        for other in (merged[name], again[name], exact[name]):
            assert [one[k] for k in ("type", "count", "null_count", "min", "max")] == [other[k] for k in ("type", "count", "null_count", "min", "max")]
            assert one["mean"] == other["mean"] or abs(one["mean"] - other["mean"]) < 1e-9 * abs(one["mean"])
    for name, n in (("id", 30_000), ("text", 977), ("t", 30_000), ("flag", 2), ("none", 0)):
        assert abs(merged[name]["distinct"] - n) <= 0.03 * n
    assert abs(merged["id"]["median"] - 15_000) < 900 and abs(merged["id"]["q25"] - 7_500) < 900 and merged["none"]["median"] is None
    wider = merge_states(profile_state(spark.range(5)), profile_state(spark.range(3).selectExpr("id + 0.5D AS id", "'a' AS more")))
    assert {r["name"]: (r["type"], r["count"]) for r in profile_of(wider).collect()} == {"id": ("float64", 8), "more": ("string", 3)}


@pytest.mark.parametrize("needle", ["abc", "  ABc ", "xyz", "aa", "é", "", "a.c", "longer needle than the index looks up", "\U0001f642ab", "bca"])
def test_indexed_search_equals_the_scan(spark, needle):
    texts = ["abc", "xABCx", "ab c", None, "", "aéa", "bcabca", "a.c", "axc", "\U0001f642abc", "a longer needle than the index looks up!", "aa", "xy\nz", "xyz" * 2000]
    df = spark.createDataFrame([(i, t, "abc" if i % 5 == 0 else None) for i, t in enumerate(texts)], "id long, a string, b string")
    path = scratch_dir(spark, "t") + "/index"
    write_text_index(df, path, "id", ["a", "b"])
    got = {r["id"] for r in text_search_indexed(spark, df, path, needle, "id", ["a", "b"]).collect()}
    assert got == {r["id"] for r in text_search(df, needle, ["a", "b"]).collect()}


def scanned(df):
    """Rows that the file scans of a plan gave, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_reads_few_rows(spark):
    """Under a twentieth of the table, for keys that are there and for one that is not."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    path = scratch_dir(spark, "t") + "/lines"
    write_lookup_table(lines, path, "l_orderkey", 500)
    table = spark.read.parquet(path)
    assert scanned(table.where("l_orderkey = 7")) < lines.count() / 20
    assert scanned(table.where("l_orderkey = -5")) == 0
    keys = [r[0] for r in lines.select("l_orderkey").distinct().limit(3).collect()]
    found = key_lookup(table, f"l_orderkey IN ({', '.join(map(str, keys))})")
    assert sorted(map(str, found.collect())) == sorted(map(str, lines.where(F.col("l_orderkey").isin(keys)).collect()))


def test_a_busy_minute_spreads_over_tasks(spark, conf):
    """One key has a third of all rows within one minute."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="16")
    at = "timestamp_micros(1700000000000000 + CASE WHEN id % 3 = 0 THEN (id * 997) % 60000000 ELSE id * 1000000 END)"
    df = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 'hot', CONCAT('k', id % 50)) AS k", f"{at} AS ts")
    used = trailing_usage(df, ["k"], "ts")
    tasks = used.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 1500
    plain = df.selectExpr("id", "count(*) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL '59:59.999999' MINUTE TO SECOND PRECEDING AND CURRENT ROW) AS used")
    assert sorted(map(tuple, used.select("id", "used").collect())) == sorted(map(tuple, plain.collect()))
