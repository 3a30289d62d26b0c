"""Files, SQL, landed pages, typing, sinks and names."""

import glob
import json
from datetime import datetime, timezone

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import plan_of
from tidewell.frame import Frame, Meta
from tidewell.session import scratch_dir
from tidewell.sinks import (
    export_name, read_envelope, render_key, write_csv, write_envelope, write_json, write_json_array, write_tsv,
)
from tidewell.sources import (
    all_text, api_items, apply_column_types, broken_lines, check_read_only, crawl_audit, crawl_gaps, graphql_rows, infer_column_types, infer_format,
    key_lookup, list_objects, next_page, read_csv, read_json_documents, read_ndjson, read_object, read_source,
    register_source, settled, sql_query, time_window,
)


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, newline="")
        return str(path)

    return write


def test_csv(spark, put, rows):
    df = read_csv(spark, put("a.csv", "id,name\n1,alice\n2,bob\n"))
    assert dict(df.dtypes) == {"id": "string", "name": "string"}
    assert rows(df)[0] == {"id": "1", "name": "alice"}
    assert rows(read_csv(spark, put("b.csv", "id;name\n1;alice\n"), ";")) == [{"id": "1", "name": "alice"}]


def test_csv_ragged_and_empty_fields(spark, put, rows):
    text = 'a,b,c\n1,,"q,""z"\n2,b\n\n3,c,d,e\n4,"",\n"5,""x"\n'
    assert rows(read_csv(spark, put("r.csv", text)), "a") == [
        {"a": "1", "b": "", "c": 'q,"z'}, {"a": "2", "b": "b", "c": None}, {"a": "3", "b": "c", "c": "d"},
        {"a": "4", "b": "", "c": ""}, {"a": '5,"x', "b": None, "c": None},
    ]
    # A narrower select must see the same values.
    assert rows(read_csv(spark, put("r.csv", text)).select("b"))[0] == {"b": ""}


def test_csv_empty_file_and_line_breaks(spark, put, rows):
    assert read_csv(spark, put("e.csv", "")).columns == []
    assert read_csv(spark, put("h.csv", "id,name\n")).count() == 0
    df = read_csv(spark, put("m.csv", 'id,t\r\n1,"x\ny"\r\n2,z\r\n'), multi_line=True)
    assert rows(df) == [{"id": "1", "t": "x\ny"}, {"id": "2", "t": "z"}]


def test_ndjson(spark, put, rows):
    assert read_ndjson(spark, put("a.ndjson", '{"id":1}\n\n{"id":2}\n')).count() == 2
    broken = put("b.ndjson", '{"id":1}\n{"id":\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        read_ndjson(spark, broken, "id long").collect()
    kept = rows(read_ndjson(spark, broken, "id long", quarantine=True), F.desc_nulls_last("id"))
    assert kept == [{"id": 1, "_corrupt_record": None}, {"id": None, "_corrupt_record": '{"id":'}]


def test_json_documents(spark, put, rows):
    schema = "id long, name string, value string"
    assert [r["id"] for r in rows(read_json_documents(spark, put("a.json", '[{"id":1},\n {"id":2}]'), schema))] == [1, 2]
    assert rows(read_json_documents(spark, put("o.json", '{"id":1,"name":"solo"}'), schema)) == [
        {"id": 1, "name": "solo", "value": None}
    ]
    assert [r["value"] for r in rows(read_json_documents(spark, put("s.json", '[5,"x",{"value":"v"}]'), schema))] == ["5", "x", "v"]
    assert read_json_documents(spark, put("n.json", "null"), schema).count() == 0
    assert dict(read_json_documents(spark, put("v.json", "[1]")).dtypes) == {"item": "variant"}


@pytest.mark.parametrize("schema", ["a long", "a long, value string"])
def test_json_items_that_are_no_objects(spark, put, rows, schema):
    """The same rows whatever the schema: scalars are rows, null documents none."""
    def read(text):
        return rows(read_json_documents(spark, put("x.json", text), schema))

    def row(a, value=None):
        return {"a": a, "value": value} if "value" in schema else {"a": a}

    assert read('[{"a":1},5]') == [row(1), row(None, "5")]
    assert read("null") == [] and read("[]") == []
    assert read("7") == [row(None, "7")] and read('{"a":3}') == [row(3)]
    assert read('[{"a":"5"},{"a":1}]') == [row(5), row(1)]
    assert read('[{"a":1,"b":[2]},{}]') == [row(1), row(None)]
    for broken in ('[{"a":1},{', '[{"a":"x"},{"a":1}]'):
        with pytest.raises((PySparkException, Py4JJavaError)):
            read(broken)


def brute_broken(text):
    found = []
    for number, line in enumerate(text.split("\n"), 1):
        try:
            good = not line.strip() or isinstance(json.loads(line), dict)
        except ValueError:
            good = False
        if not good:
            found.append((number, line))
    return found


def test_broken_lines_are_numbered(spark, tmp_path, conf):
    """Several splits a file, several files, blank lines, long lines, no line end at the end."""
    conf(spark__sql__files__maxPartitionBytes="700", spark__sql__files__openCostInBytes="1")
    texts = {}
    for name in ("a", "b", "empty"):
        lines = [] if name == "empty" else ['{"k": %d}' % i if i % 7 else ("" if i % 2 else ("x" * (i % 900) + "{" if i % 3 else "[1]")) for i in range(len(name) + 600)]
        texts[name] = "\n".join(lines)
        (tmp_path / f"{name}.ndjson").write_text(texts[name])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in broken_lines(spark, str(tmp_path)).collect())
    assert found == sorted((f"{n}.ndjson", i, line) for n, t in texts.items() for i, line in brute_broken(t)) and len(found) > 50


def test_format_by_extension(spark, put):
    names = ["data.csv", "logs/file.NDJSON", "events.jsonl", "payload.json", "no-extension"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select(infer_format(F.col("p")))
    assert [r[0] for r in df.collect()] == ["csv", "ndjson", "ndjson", "json", "json"]
    assert read_object(spark, put("a.csv", "id\n1\n")).count() == 1
    with pytest.raises(ValueError, match="unsupported object format"):
        read_object(spark, "x", "xml")


def test_list_objects(spark, put, tmp_path):
    put("a.csv", "id\n1\n")
    put("b.txt", "x")
    (row,) = list_objects(spark, str(tmp_path), "*.csv").collect()
    assert row["key"].endswith("/a.csv") and row["size"] == 5


GUARD = {
    "SELECT * FROM users": True, "WITH recent AS (SELECT 1) SELECT * FROM recent": True, "SELECT 1;": True, "": False,
    "INSERT INTO users (email) VALUES ('x')": False, "UPDATE users SET email = 'x'": False, "DELETE FROM users": False,
    "DROP TABLE users": False, "SELECT 1; DROP TABLE users;": False, "EXPLAIN SELECT 1": False,
    "SELECT created_at FROM users": True, "SELECT replace(a, 'b', 'c') FROM t": False, "SELECT 'please UPDATE' AS x": False,
    "SELECT 1;;": False, "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')": False,
    "SELECT java_method ('a', 'b')": False, "SELECT reflect FROM t": True, "SELECT 1; SELECT 2": False, "SET x = 1": False, "": False, "WITH a AS (SELECT 1) SELECT * FROM a;": True,
    "FROM t SELECT 1": True, "SHOW TABLES": False, "SELECT reflect/**/('a', 'b')": False, "SELECT `reflect` /* x */ ('a', 'b')": False,
    "SELECT reflect -- x\n ('a', 'b')": False, "SELECT `Try_Reflect`('a', 'b')": False, "SELECT system.builtin.reflect('a', 'b')": False,
    "SELECT IDENTIFIER('ref' || 'lect')('a', 'b')": False, "SELECT 'reflect(x)' AS x, \"/*\" AS y": True, "SELECT a /* reflect( */ FROM t -- reflect(": True,
    "BEGIN SELECT 1; END": False, "SELECT identifier FROM t": True,
}


@pytest.mark.parametrize("sql", GUARD)
def test_read_only_guard(sql):
    if GUARD[sql]:
        check_read_only(sql)
    else:
        with pytest.raises(ValueError):
            check_read_only(sql)


def test_sql_query(spark, rows):
    t = spark.range(5).toDF("n")
    assert rows(sql_query(spark, "SELECT n FROM t WHERE n > ? AND n < ?;", [1, 3], {"t": t})) == [{"n": 2}]
    assert rows(sql_query(spark, "SELECT n FROM t WHERE n = :k", {"k": 4}, {"t": t})) == [{"n": 4}]
    assert "t" not in [x.name for x in spark.catalog.listTables()]
    spark.range(2).createOrReplaceTempView("t")
    assert sql_query(spark, "SELECT n FROM t", tables={"t": t}).count() == 5
    assert spark.table("t").columns == ["id"]
    spark.catalog.dropTempView("t")


def test_all_text(spark, rows):
    df = spark.sql("SELECT 1 a, 2.5D b, CAST('hi' AS BINARY) c, CAST(NULL AS INT) d")
    assert rows(all_text(df)) == [{"a": "1", "b": "2.5", "c": "hi", "d": None}]


def pages_table(spark, pages):
    return spark.createDataFrame(pages, "crawl_id string, page_no int, status int, link_header string, body string")


def test_api_items_over_pages(spark, rows):
    pages = pages_table(spark, [
        ("c", 0, 200, None, '{"items":[{"id":1},{"id":2}]}'), ("c", 1, 200, None, '{"items":[{"id":3}]}'),
        ("c", 2, 200, None, '{"items":null}'), ("c", 3, 200, None, "{}"), ("c", 4, 200, None, ""),
        ("c", 5, 200, None, '{"items":{"id":4}}'), ("c", 6, 200, None, '{"items":"loose"}'),
    ])
    got = rows(api_items(pages, "items", "id long, value string"), "page_no", "pos")
    assert [(r["page_no"], r["id"], r["value"]) for r in got] == [
        (0, 1, None), (0, 2, None), (1, 3, None), (5, 4, None), (6, None, "loose"),
    ]
    # Without a path the whole body is the row.
    whole = api_items(pages.where("page_no = 1"), "")
    assert rows(whole.select(F.to_json("item").alias("i"))) == [{"i": '{"items":[{"id":3}]}'}]


def test_api_error_status_fails(spark):
    pages = pages_table(spark, [("c", 0, 401, None, "{}")])
    with pytest.raises(PySparkException, match="upstream returned status 401"):
        api_items(pages, "").collect()


def test_graphql_rows(spark, rows):
    pages = pages_table(spark, [
        ("g", 0, 200, None, '{"data":{"search":{"edges":[{"node":{"id":1,"title":"one"}},{"node":{"id":2,"title":"two"}}]}}}'),
        ("g", 1, 200, None, '{"data":{"search":{"edges":[{"id":3},7,{"node":null}]}}}'),
        ("g", 2, 200, None, '{"errors":[{"message":"field not found"}]}'),
        ("g", 3, 200, None, '{"data":{"search":[{"id":5}]},"errors":[]}'),
        ("g", 4, 200, None, '{"data":{"search":{"id":6}}}'), ("g", 5, 200, None, '{"data":{"search":null}}'),
    ])
    good, bad = graphql_rows(pages, "data.search", "id long, title string, value string")
    got = [(r["page_no"], r["id"], r["title"], r["value"]) for r in rows(good, "page_no", "pos")]
    assert got == [
        (0, 1, "one", None), (0, 2, "two", None), (1, 3, None, None), (1, None, None, "7"), (1, None, None, None),
        (3, 5, None, None), (4, 6, None, None),
    ]
    assert rows(bad) == [{"crawl_id": "g", "page_no": 2, "error": "field not found"}]


def tokens(spark, strategy, bodies, path="", headers=None, **options):
    pages = pages_table(spark, [("c", i, 200, (headers or {}).get(i), b) for i, b in enumerate(bodies)])
    return [r["next_token"] for r in next_page(pages, strategy, path, **options).orderBy("page_no").collect()]


def test_next_page_strategies(spark):
    assert tokens(spark, "offset", ['{"i":[1,2]}', '{"i":[3]}', '{"i":[]}', "{}", "bad"], "i", page_size=2) == [
        "2", None, None, None, None,
    ]
    assert tokens(spark, "page", ["[1]", "[]", "[2]"]) == ["2", None, "4"]
    assert tokens(spark, "cursor", ['{"m":{"c":"x"}}', '{"m":{"c":""}}', '{"m":{"c":12}}', '{"m":{"c":1.5e3}}', '{"m":{"c":true}}', '{"m":{"c":[1]}}', "{}"], "m.c") == [
        "x", None, "12", "1500", "true", None, None,
    ]
    links = {
        0: '<https://a/x?page=2>; rel="next", <https://a/x?page=9>; rel="last"', 1: '<https://a/x?page=1>; rel="prev"',
        2: "<https://a/p>; rel=prev, <https://a/n>; rel=next", 3: "nonsense",
    }
    assert tokens(spark, "link", ["{}"] * 5, headers=links) == ["https://a/x?page=2", None, "https://a/n", None, None]
    relay = ['{"d":{"pageInfo":{"hasNextPage":true,"endCursor":"c1"}}}', '{"d":{"pageInfo":{"hasNextPage":false,"endCursor":"c2"}}}', '{"d":{}}', '{"d":{"pageInfo":{"hasNextPage":true}}}']
    assert tokens(spark, "relay", relay, "d") == ["c1", None, None, None]
    with pytest.raises(ValueError, match="unknown pagination strategy"):
        tokens(spark, "magic", [])


def test_cursor_numbers_are_exact(spark):
    bodies = ['{"c":%s}' % n for n in ("1e-20", "-2.50e-3", "1e25", "123456789012345678901234567890", "0.10", "1.5e3", "0", "12345678901234567")]
    assert tokens(spark, "cursor", bodies, "c") == [
        "0.00000000000000000001", "-0.0025", "10000000000000000000000000", "123456789012345678901234567890", "0.1", "1500", "0", "12345678901234567",
    ]


def test_links_with_commas(spark):
    links = {0: '<https://x/p?ids=1,2&page=2>; rel="next"', 1: '<https://x/a,b>; rel="prev"; title="a, b", <https://x/c>; title="x, y"; rel=next', 2: '<https://x/n>; rel=nextish'}
    assert tokens(spark, "link", ["{}"] * 3, headers=links) == ["https://x/p?ids=1,2&page=2", "https://x/c", None]


def test_broken_page_is_no_end(spark):
    pages = pages_table(spark, [("c", 0, 200, None, '{"i":[1,2]}'), ("c", 1, 200, None, '{"i":[3,')] + [("d", 0, 200, None, '{"i":[1]}')])
    got = {r["crawl_id"]: r for r in crawl_audit(next_page(pages, "offset", "i", 2), 5).collect()}
    assert got["c"]["failed_pages"] == 1 and not got["c"]["complete"] and not got["c"]["truncated"]
    assert got["d"]["failed_pages"] == 0 and got["d"]["complete"]


def test_crawl_audit(spark, rows):
    table = spark.createDataFrame(
        [("full", i, 200, str(i + 1), False) for i in range(3)] + [("done", 0, 200, "1", False), ("done", 1, 200, None, False)]
        + [("gap", 0, 200, "1", False), ("gap", 2, 200, "3", False)] + [("broken", i, s, "x", False) for i, s in ((0, 200), (1, 200), (2, 500))],
        "crawl_id string, page_no int, status int, next_token string, broken boolean",
    )
    got = {r["crawl_id"]: r for r in rows(crawl_audit(table, max_pages=3))}
    assert {k: v["truncated"] for k, v in got.items()} == {"full": True, "done": False, "gap": False, "broken": False}
    assert got["gap"]["missing_pages"] == 1 and got["broken"]["failed_pages"] == 1
    assert {r["repeated_pages"] for r in got.values()} == {0}


def test_pages_that_landed_twice(spark, rows):
    """They hide no gap; of a failed and a good copy the good one counts."""
    table = spark.createDataFrame(
        [("c", 0, 200, "1", False)] * 2 + [("c", 2, 200, None, False)] + [("d", 0, 200, "1", False), ("d", 1, 500, None, False), ("d", 1, 200, None, False)]
        + [("e", 3, 200, "4", False), ("e", 7, 200, None, False), ("e", 7, 200, None, False), ("f", None, 200, None, False)],
        "crawl_id string, page_no int, status int, next_token string, broken boolean",
    )
    got = {r["crawl_id"]: r for r in rows(crawl_audit(table))}
    assert (got["c"]["missing_pages"], got["c"]["repeated_pages"], got["c"]["complete"]) == (1, 1, False)
    assert (got["d"]["missing_pages"], got["d"]["failed_pages"], got["d"]["repeated_pages"], got["d"]["complete"]) == (0, 0, 1, True)
    gaps = [(r["crawl_id"], r["first"], r["last"], r["missing"]) for r in rows(crawl_gaps(table), "crawl_id", "first")]
    assert gaps == [("c", 1, 1, 1), ("e", 0, 2, 3), ("e", 4, 6, 3)]


def test_key_lookup_needs_a_key(spark):
    df = spark.range(10)
    with pytest.raises(ValueError, match="key condition"):
        key_lookup(df)
    assert key_lookup(df, "id > 3", "id % 2 = 0", limit=2).count() == 2
    assert key_lookup(df, scan=True).count() == 10


def test_time_window_defaults_to_the_last_hour(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 03:00:00', INTERVAL 30 MINUTES)) t")
    end = datetime(2024, 1, 1, 3, tzinfo=timezone.utc)
    assert time_window(df, "t", end=end).count() == 3
    naive = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert time_window(naive, "t", datetime(2024, 1, 1), end).count() == 7
    assert time_window(df, "t").count() == 0


def test_infer_and_override_types(spark, rows):
    df = spark.createDataFrame(
        [("1", "1", "true", "2024-01-02", "2024-01-02 10:00:00", "x", None, "9999999999999999999"), ("-2", "2.5", "FALSE", "2024-02-30", "2024-01-02T10:00", "1", None, "1")],
        "i string, f string, b string, bad_date string, t string, mixed string, none string, long string",
    )
    got = {r["name"]: r["type"] for r in rows(infer_column_types(df))}
    ids = spark.createDataFrame([("9223372036854775807", "00123", "-9223372036854775808", "0", "1.", "007.5", "")], "a string, b string, c string, d string, e string, f string, g string")
    assert {r["name"]: r["type"] for r in rows(infer_column_types(ids))} == {"a": "int", "b": "string", "c": "int", "d": "int", "e": "float", "f": "string", "g": "string"}
    wide = spark.range(3).select(*[F.col("id").cast("string").alias(f"column {i}`") for i in range(60)])
    assert {r["type"] for r in rows(infer_column_types(wide))} == {"int"} and infer_column_types(wide).count() == 60
    assert got == {
        "i": "int", "f": "float", "b": "bool", "bad_date": "string", "t": "datetime", "mixed": "string", "none": "string",
        "long": "float",
    }
    good, bad = apply_column_types(df.select("i", "mixed", "none"), {"i": "int", "mixed": "int", "none": "date"})
    assert dict(good.dtypes) == {"i": "bigint", "mixed": "bigint", "none": "date"}
    assert rows(good) == [{"i": -2, "mixed": 1, "none": None}]
    assert rows(bad) == [{"i": "1", "mixed": "x", "none": None, "bad_columns": ["mixed"]}]
    with pytest.raises(ValueError, match="unknown column types"):
        apply_column_types(df, {"i": "money"})


def test_read_source(spark, put, people_table):
    frame = read_source(spark, {"table": "people", "max_columns": 1, "row_limit": 1}, {"people": people_table})
    assert frame.df.columns == ["id"] and frame.df.count() == 1 and frame.meta.truncated
    assert (frame.meta.name, frame.meta.source_type) == ("people", "table")
    assert read_source(spark, {"path": put("a.csv", "id\n1\n")}).df.count() == 1
    assert read_source(spark, {"sql": "SELECT id FROM people WHERE id = 2"}, {"people": people_table}).df.count() == 1
    register_source("numbers", lambda s, c, t: s.range(c["n"]))
    assert read_source(spark, {"kind": "numbers", "n": 4, "all_text": True}).df.dtypes == [("id", "string")]
    with pytest.raises(ValueError, match="unknown source kind"):
        read_source(spark, {"kind": "nope"})
    with pytest.raises(ValueError, match="needs a table"):
        read_source(spark, {})


@pytest.fixture
def people_table(spark):
    return spark.createDataFrame([(1, "alice"), (2, "bob")], "id long, name string")


def parts_of(path):
    return sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"))


def open_text(path):
    with open(path) as file:
        return file.read()


def part_text(path):
    path = path.removeprefix("file://")
    import glob

    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_csv_export_bytes(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 'say "hi"', "a,b", None, " pad "), (2, 12345678.5, "line\nbreak", "", "", "x")],
        "n int, d double, q string, c string, e string, p string",
    ).coalesce(1)
    path = scratch_dir(spark, "t") + "/csv"
    write_csv(df, path)
    assert part_text(path) == (
        'n,d,q,c,e,p\r\n1,2,"say ""hi""","a,b",, pad \r\n2,12345678.5,"line\nbreak",,,x\r\n'
    )
    with pytest.raises(PySparkException):
        write_csv(df, path)
    write_csv(df, path, max_rows=1, mode="overwrite")
    assert part_text(path).count("\r\n") == 2


def test_csv_export_quotes_only_where_needed(spark):
    values = ["plain", "tab\there", "'single'", "#hash", "cr\rhere", "\\back", "comma,", "semi;"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    path = scratch_dir(spark, "t") + "/csv"
    write_csv(df, path)
    want = [v if not any(c in v for c in ',"\r\n') else f'"{v}"' for v in values]
    assert part_text(path) == "v\r\n" + "".join(w + "\r\n" for w in want)


def test_csv_export_header_in_every_part(spark, rows):
    path = scratch_dir(spark, "t") + "/csv"
    df = spark.range(100).repartition(4).select("id", F.concat(F.lit("v,"), "id").alias("v"))
    write_csv(df, path)
    assert part_text(path).count("id,v\r\n") == 4
    assert [r["v"] for r in rows(read_csv(spark, path), F.col("id").cast("int"))] == [f"v,{i}" for i in range(100)]
    write_csv(df.where("id < 0"), path, mode="overwrite")
    assert part_text(path) == "id,v\r\n"


def test_csv_export_nested(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', CAST(NULL AS INT)) s, array('x') l").coalesce(1)
    path = scratch_dir(spark, "t") + "/csv"
    write_csv(df, path)
    assert part_text(path) == 's,l\r\n"{""a"":1,""b"":null}","[""x""]"\r\n'


def test_tsv_export_does_not_quote(spark):
    df = spark.createDataFrame([('a "b"', "c,d", None)], "x string, y string, z string").coalesce(1)
    path = scratch_dir(spark, "t") + "/tsv"
    write_tsv(df, path)
    assert part_text(path) == 'x\ty\tz\na "b"\tc,d\t\n'


def test_json_exports(spark):
    df = spark.sql("SELECT 1 a, CAST(NULL AS STRING) b, TIMESTAMP_NTZ '2024-01-02 03:04:05' t").coalesce(1)
    folder = scratch_dir(spark, "t")
    write_json(df, folder + "/lines")
    assert json.loads(part_text(folder + "/lines")) == {"a": 1, "b": None, "t": "2024-01-02T03:04:05Z"}
    numbers = spark.range(5).coalesce(1)
    write_json_array(numbers, folder + "/array", order_by=["id"])
    assert json.loads(part_text(folder + "/array")) == [{"id": i} for i in range(5)]
    write_json_array(spark.range(0, 25_000, 1, 4), folder + "/many", rows_per_file=3_000)
    arrays = [json.loads(open(f).read()) for f in sorted(glob.glob(folder.removeprefix("file:") + "/many/part-*"))]
    assert len(arrays) > 8 and all(0 < len(a) <= 3_000 for a in arrays)
    assert sorted(r["id"] for a in arrays for r in a) == list(range(25_000))
    write_json_array(spark.range(20, 0, -1), folder + "/sorted", rows_per_file=6, order_by=["id"])
    arrays = [json.loads(open(f).read()) for f in sorted(glob.glob(folder.removeprefix("file:") + "/sorted/part-*"))]
    assert [r["id"] for a in arrays for r in a] == list(range(1, 21))
    wide = spark.range(0, 300, 1, 2).selectExpr("id", "repeat('x', IF(id = 7, 9000, 100)) AS pad")
    write_json_array(wide, folder + "/wide", bytes_per_file=1_000)
    sizes = [len(text) for text in map(open_text, parts_of(folder + "/wide"))]
    assert len(sizes) >= 30 and sorted(sizes)[-2] < 1_300 and read_json_documents(spark, folder + "/wide", "id long").distinct().count() == 300
    write_json_array(numbers.where("false"), folder + "/none")
    assert json.loads(part_text(folder + "/none")) == []
    with pytest.raises(ValueError):
        write_json_array(numbers, folder + "/no", rows_per_file=0)


def test_envelope_round_trip(spark, people_table, rows):
    meta = Meta(name="people", source_type="table", lineage=("a", "b"), truncated=True, warnings=("w",), extra={"k": 1})
    path = scratch_dir(spark, "t") + "/envelope"
    nested = people_table.withColumn("s", F.struct(F.col("id").alias("x"), F.lit(None).cast("date").alias("y")))
    write_envelope(Frame(nested, meta), path)
    frame = read_envelope(spark, path)
    assert rows(frame.df, "id") == rows(nested, "id")
    assert frame.meta == meta and frame.df.schema.simpleString() == nested.schema.simpleString()


def test_names():
    moment = datetime(2024, 1, 31, 8, 5, 9, 123456, tzinfo=timezone.utc)
    assert export_name("My table / x", "csv", moment) == "My_table_x-2024-01-31T08-05-09-123Z.csv"
    assert export_name("", "json", moment).startswith("query-result-2024")
    assert render_key("{{workflow_id}}/{{yyyy}}/{{mm}}/{{dd}}/{{hh}}/{{run_id}}-{{ts}}", "w", "n", "r", moment) == (
        "w/2024/01/31/08/r-2024-01-31T08:05:09Z"
    )
    with pytest.raises(ValueError, match="unknown placeholder"):
        render_key("{{nope}}")


def test_guards_note_in_the_run_itself(spark, conf):
    """Cut cells, few values, rows: known after the run, of all rows though a filter follows; no run, no notes."""
    conf(spark__sql__shuffle__partitions="3")
    df = spark.range(0, 5000, 1, 6).selectExpr(
        "id", "CAST(id % 128 AS STRING) AS few", "CAST(id % 129 AS STRING) AS more", "CAST(id AS STRING) AS many", "CAST(NULL AS STRING) AS none",
        "CASE WHEN id % 10 = 0 THEN repeat('x', 50) ELSE IF(id % 2 = 0, 'y', NULL) END AS long", "unhex('00112233') AS raw",
    )
    config = {"table": "t", "max_string_bytes": 20, "max_binary_bytes": 3, "dictionary_threshold": True}
    frame = read_source(spark, config, {"t": df})
    frame.df.write.format("noop").mode("overwrite").save()
    assert frame.df.where("id = 10").select("long", "raw").first() == ("x" * 20 + "…(truncated)", bytearray(b"\x00\x11\x22"))
    meta = settled(frame).meta
    assert meta.row_count == 5000 and meta.warnings == ("5500 cell(s) exceeded per-type cell limits and were truncated",)
    assert meta.extra["dictionaryColumns"] == {"few": 128, "long": 2}
    plain = read_source(spark, {"table": "t"}, {"t": df})
    assert settled(plain) is plain and plain.watch is None


def test_guards_cost_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frame = read_source(spark, {"table": "t", "max_string_bytes": 2000, "dictionary_threshold": 128}, {"t": df})
    plan = plan_of(frame.df)
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("CollectMetrics") == 1


def test_notes_of_a_run_that_never_was(spark, monkeypatch):
    from tidewell.sources import guards

    monkeypatch.setattr(guards, "PATIENCE", 0.1)
    frame = read_source(spark, {"table": "t", "max_string_bytes": 5}, {"t": spark.range(3)})
    assert settled(frame).meta == frame.meta


def test_source_kinds(spark, put, tmp_path, rows):
    logs = {"a": spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS t, 1 AS n"), "b": spark.sql("SELECT TIMESTAMP '2024-01-01 11:30:00' AS t, 'x' AS m")}
    config = {"tables": ["a", "b"], "time_column": "t", "start": "2024-01-01T11:00:00", "end": "2024-01-01T12:00:00"}
    assert [r["m"] for r in rows(read_source(spark, config, logs).df)] == ["x"]
    put("one.csv", "id,when\n1,2024-05-01\n2,\n")
    listed = read_source(spark, {"kind": "listing", "path": str(tmp_path), "pattern": "*.csv"})
    assert listed.meta.source_type == "listing" and listed.df.columns == ["key", "size", "lastModified"]
    typed = read_source(spark, {"path": str(tmp_path / "one.csv"), "columns": ["when", "id"], "columnTypes": {"id": "int", "when": "date"}}).df
    assert typed.dtypes == [("when", "date"), ("id", "bigint")] and [r["id"] for r in rows(typed, "id")] == [1, 2]
    wrong = read_source(spark, {"path": put("two.csv", "id\nseven\n"), "columnTypes": {"id": "int"}}).df
    with pytest.raises(Exception, match="column id: no int: seven"):
        wrong.collect()
    with pytest.raises(ValueError, match="unknown column types"):
        read_source(spark, {"path": str(tmp_path / "one.csv"), "columnTypes": {"id": "integer!"}})


def test_graphql_source(spark, rows):
    pages = pages_table(spark, [("g", 0, 200, None, '{"data":{"s":{"edges":[{"node":{"id":1}},{"id":2}]}}}'), ("g", 1, 200, None, '{"errors":[{"message":"no such field"}]}')])
    config = {"table": "p", "data_path": "data.s", "schema": "id long"}
    assert [r["id"] for r in rows(read_source(spark, {**config, "errors": "skip"}, {"p": pages}).df, "id")] == [1, 2]
    with pytest.raises(Exception, match="no such field"):
        read_source(spark, config, {"p": pages}).df.collect()
