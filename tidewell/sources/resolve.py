"""Turn a source configuration into a frame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.frame import Frame, Meta, col
from tidewell.operators.union import concat
from tidewell.sources.api_pages import api_items, graphql_rows
from tidewell.sources.files import list_objects, read_object
from tidewell.sources.guards import guarded
from tidewell.sources.lookup import key_lookup, time_window
from tidewell.sources.sql import all_text, read_jdbc, sql_query
from tidewell.sources.typing import declared_types

Reader = Callable[[SparkSession, Mapping[str, Any], Mapping[str, DataFrame]], DataFrame]
_READERS: dict[str, Reader] = {}


def register_source(kind: str, reader: Reader) -> None:
    """Add a source kind: `reader(spark, config, tables) -> DataFrame`."""
    _READERS[kind] = reader


def read_source(
    spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame] | None = None
) -> Frame:
    """Read a source: a named table, files, a query, landed REST or GraphQL pages, a key lookup, a time window or a listing.

    `config["kind"]` picks the reader (guessed from the other keys when absent). `columnTypes` converts text columns, `all_text` makes
    every column text. The opt-in guards are those of `guarded`.
    """
    kind = source_kind(config)
    if kind not in _READERS:
        raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(sorted(_READERS))}")
    df = _READERS[kind](spark, config, tables or {})
    if config.get("columnTypes"):
        df = declared_types(df, config["columnTypes"])
    if config.get("all_text"):
        df = all_text(df)
    name = config.get("name") or config.get("table") or ""
    return guarded(Frame(df, Meta(name=name, source_type=kind, source_id=config.get("source_id", ""))), config)


def source_kind(config: Mapping[str, Any]) -> str:
    """The kind of a source, guessed from its keys unless named."""
    if config.get("kind"):
        return config["kind"]
    for key, kind in (
        ("url", "jdbc"), ("sql", "sql"), ("items_path", "pages"), ("data_path", "graphql"), ("key_condition", "lookup"),
        ("time_column", "time_window"), ("pattern", "listing"),
    ):
        if key in config:
            return kind
    return "file" if "path" in config else "table"


def _table(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    name = config.get("table")
    if not name:
        raise ValueError("source needs a table, path, sql or url")
    return tables[name] if name in tables else spark.table(name)


def _file(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    options = {k: config[k] for k in ("format", "delimiter", "schema", "multi_line") if k in config}
    df = read_object(spark, config["path"], **options)
    return df.select(*[col(c) for c in config["columns"]]) if config.get("columns") else df


def _sql(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    return sql_query(spark, config["sql"], config.get("params"), tables)


def _jdbc(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    options = {k: config[k] for k in ("properties", "partition_column", "bounds", "partitions") if k in config}
    return read_jdbc(spark, config["url"], config["sql"], **options)


def _pages(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    return api_items(_table(spark, config, tables), config.get("items_path", ""), config.get("schema"))


def _graphql(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of landed GraphQL pages. A page whose response lists errors fails the flow, unless `errors` is "skip"."""
    pages = _table(spark, config, tables)
    return graphql_rows(pages, config.get("data_path", ""), config.get("schema"), fail=config.get("errors", "fail") != "skip")[0]


def _listing(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    return list_objects(spark, config["path"], config.get("pattern", "*"), config.get("recursive", True))


def _window(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of one or several log tables (`table` or `tables`), one below the other, by default of the last hour."""
    names = config.get("tables") or [config.get("table")]
    start, end = (datetime.fromisoformat(v) if isinstance(v := config.get(k), str) else v for k in ("start", "end"))
    rows = concat(*[_table(spark, {"table": n}, tables) for n in names])
    return time_window(rows, config["time_column"], start, end)


def _lookup(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    return key_lookup(
        _table(spark, config, tables), config.get("key_condition", ""), config.get("filter", ""),
        config.get("scan", False), config.get("limit"),
    )


for _kind, _reader in (
    ("table", _table), ("file", _file), ("sql", _sql), ("jdbc", _jdbc), ("pages", _pages), ("graphql", _graphql), ("lookup", _lookup),
    ("time_window", _window), ("listing", _listing),
):
    register_source(_kind, _reader)
