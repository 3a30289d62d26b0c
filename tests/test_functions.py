"""Column functions on tables of examples."""

import pytest
from pyspark.sql import functions as F, types as T

from tidewell.functions import (
    cell_text, chart_number, chartable_fields, classify_code, classify_error, cursor_text, default_chart, error_trip_kind,
    json_path, number_text, query_hash, query_summary, soft_limit_bucket, time_text, trip_kinds, uuid_text,
)
from tidewell.functions.jsons import bounded_json_verdict, is_json, json_depth, json_tokens


def apply(spark, values, dtype, function):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(function(F.col("v"))).collect()]


ERRORS = {
    "password authentication failed for user": "auth_failed", "403 Forbidden": "permission_denied",
    "dial tcp: no such host": "network_unreachable", "context deadline exceeded while waiting": "timeout",
    'relation "foo" does not exist': "not_found", "429 Too Many Requests": "rate_limited",
    "something completely unrecognized happened": "unknown", "Endpoint is required.": "invalid_config",
    "HTTP 401": "auth_failed", "upstream returned status 404": "not_found", "Throttled": "rate_limited",
}
CODES = {
    ("postgres", "28P01"): "auth_failed", ("postgres", "28000"): "auth_failed", ("postgres", "3D000"): "not_found",
    ("postgres", "42501"): "permission_denied", ("postgres", "XXUNK"): "unknown", ("mysql", "1045"): "auth_failed",
    ("mysql", "1049"): "not_found", ("mysql", "1044"): "permission_denied", ("mysql", "1142"): "permission_denied",
    ("mysql", "9999"): "unknown", ("aws", "AccessDenied"): "permission_denied",
    ("aws", "UnauthorizedException"): "permission_denied", ("aws", "InvalidAccessKeyId"): "auth_failed",
    ("aws", "ExpiredToken"): "auth_failed", ("aws", "NoSuchBucket"): "not_found",
    ("aws", "ThrottlingException"): "rate_limited", ("aws", "SomethingElse"): "unknown", ("http", "401"): "auth_failed",
    ("http", "403"): "permission_denied", ("http", "404"): "not_found", ("http", "429"): "rate_limited",
    ("http", "500"): "unknown",
}


def test_classify_error(spark):
    assert apply(spark, list(ERRORS), "string", classify_error) == list(ERRORS.values())
    assert apply(spark, [None], "string", classify_error) == [None]


def test_classify_code(spark):
    df = spark.createDataFrame(list(CODES), "vendor string, code string")
    got = [r[0] for r in df.select(classify_code(F.col("vendor"), F.col("code"))).collect()]
    assert got == list(CODES.values())


def test_trip_kinds(spark):
    warnings = [
        ["Column cap reached at 512 columns.", "3 cell(s) exceeded limits and were truncated", "column cap again"],
        ["Row count is 90", "Response body is 5 bytes"], ["nothing"], [],
    ]
    assert apply(spark, warnings, "array<string>", trip_kinds) == [
        ["cell_bytes", "max_columns"], ["http_response_body_bytes", "max_rows"], [], [],
    ]
    errors = ["json exceeds the maximum depth of 64", "5 token limit", "quota hit", "decompression ratio", "memory pressure", "x"]
    assert apply(spark, errors, "string", error_trip_kind) == [
        "json_depth", "json_elements", "quota", "decompress_ratio", "memory_pressure", None,
    ]


def test_soft_limit_bucket(spark):
    assert apply(spark, [0.8, 0.899, 0.9, 0.949, 0.95, 2.0], "double", soft_limit_bucket) == [
        "0.80", "0.80", "0.90", "0.90", "0.95", "0.95",
    ]


@pytest.mark.parametrize(
    "value, text",
    [
        (1.0, "1"), (0.5, "0.5"), (12345678.5, "12345678.5"), (1e-7, "1e-7"), (1.5e22, "1.5e+22"), (-2.25, "-2.25"),
        (0.0, "0"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.2345678901234567e-5, "0.000012345678901234568"),
        (None, None),
    ],
)
def test_number_text(spark, value, text):
    assert apply(spark, [value], "double", number_text) == [text]


def test_time_and_cell_text(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05.120' a, TIMESTAMP_NTZ '2024-01-02 03:04:05' b, true c, "
        "named_struct('x', CAST(NULL AS INT), 'y', array(1)) d, CAST(NULL AS STRING) e, DATE '2024-01-02' f"
    )
    got = df.select(*[cell_text(F.col(c), df.schema[c].dataType) for c in df.columns]).first()
    assert list(got) == ["2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05Z", "true", '{"x":null,"y":[1]}', "", "2024-01-02"]
    assert df.select(time_text(F.col("a"), T.TimestampNTZType())).first()[0] == "2024-01-02T03:04:05.12Z"


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_moments_are_exported_in_utc(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    df = spark.sql("SELECT timestamp_micros(0) a, timestamp_micros(1710054000000000 + 1) b, TIMESTAMP_NTZ '2024-03-10 02:30:00' c")
    got = df.select(*[time_text(F.col(c), df.schema[c].dataType) for c in df.columns]).first()
    assert list(got) == ["1970-01-01T00:00:00Z", "2024-03-10T07:00:00.000001Z", "2024-03-10T02:30:00Z"]


def test_uuid_text(spark):
    raw = bytes(range(16))
    assert apply(spark, [bytearray(raw)], "binary", uuid_text) == ["00010203-0405-0607-0809-0a0b0c0d0e0f"]


def test_query_hash_and_summary(spark):
    same = [
        "SELECT a FROM t", " SELECT  a\nFROM t ;", "SELECT a -- all of them\nFROM t", "SELECT a/* x */FROM t;;",
        "/* head */ SELECT a FROM t",
    ]
    other = ["SELECT '--a' FROM t", "SELECT 'a' FROM t", "select a FROM t", "SELECT '/* x */' FROM t"]
    hashes = apply(spark, same, "string", query_hash)
    assert len(set(hashes)) == 1
    assert len(set(apply(spark, other, "string", query_hash)) | set(hashes)) == 5
    assert apply(spark, ["  a \n\t b  ", "x" * 100], "string", query_summary) == ["a b", "x" * 80]


DOCUMENT = '{"a":{"b":[10,"x",1000.50,1e3,true,null,{"0":7},""]},"k.x":1}'


@pytest.mark.parametrize(
    "path, text",
    [
        ("a.b.0", "10"), ("a.b.1", "x"), ("a.b.2", "1000.5"), ("a.b.3", "1000"), ("a.b.4", "true"), ("a.b.5", None),
        ("a.b.6.0", "7"), ("a.b.7", None), ("a.b.8", None), ("a.c", None), ("a.b.x", None), ("a.b", None), ("", None),
    ],
)
def test_json_path_and_cursor(spark, path, text):
    assert apply(spark, [DOCUMENT], "string", lambda v: cursor_text(json_path(F.parse_json(v), path))) == [text]


PAYLOADS = {
    '{"a":[1,{"b":"}{[\\""}]}': (3, 10, True), '{"a":1} x': (1, 5, False), "1] , [2": (0, 4, False), "": (0, 0, False),
    "null": (0, 1, True), "[[[[]]]]": (4, 8, True), '{"a":1,"a":2}': (1, 6, True), '"x"': (0, 1, True),
    "1,2": (0, 2, False), '1}, {"v":2': (1, 7, False), "[": (1, 1, False), ' {"a": "\\\\"} ': (1, 4, True),
}


def test_json_path_with_a_quote_in_a_name(spark):
    body = '{"it\'s":{"a b":1}}'
    assert apply(spark, [body], "string", lambda v: cursor_text(json_path(F.parse_json(v), "it's.a b"))) == ["1"]


def test_json_payload_checks(spark):
    texts = list(PAYLOADS)
    assert apply(spark, texts, "string", is_json) == [p[2] for p in PAYLOADS.values()]
    valid = [t for t in texts if PAYLOADS[t][2]]
    assert apply(spark, valid, "string", json_depth) == [PAYLOADS[t][0] for t in valid]
    assert apply(spark, valid, "string", json_tokens) == [PAYLOADS[t][1] for t in valid]
    deep = "[" * 65 + "]" * 65
    cases = ['{"a":1}', deep, deep[1:-1], "[1,2,3,4,5]", "[1,", None]
    assert apply(spark, cases, "string", lambda v: bounded_json_verdict(v, 64, 200)) == [
        None, "json exceeds the maximum depth of 64", None, None, "invalid json", "empty payload",
    ]
    assert apply(spark, ["[1,2,3,4,5]"], "string", lambda v: bounded_json_verdict(v, 64, 6)) == [
        "json exceeds the 6 token limit"
    ]


def test_chart_numbers_and_fields(spark):
    texts = [" 12.5 ", "1e3", "", " ", "x", "NaN", "1d", "-.5", None]
    assert apply(spark, texts, "string", lambda v: chart_number(v, T.StringType())) == [
        12.5, 1000.0, None, None, None, None, None, -0.5, None,
    ]
    assert apply(spark, [1.0, float("inf"), float("nan")], "double", lambda v: chart_number(v, T.DoubleType())) == [
        1.0, None, None,
    ]
    df = spark.createDataFrame([], "a string, b int, c double, d boolean, e array<int>, f bigint")
    assert chartable_fields(df) == (["b", "c", "f"], ["a", "b", "c", "d", "f"])
    chart = default_chart(df)
    assert (chart.kind, chart.x, chart.y) == ("line", "a", ("b", "c"))
    assert default_chart(df.select("a", "b")).kind == "bar"
