from tidewell.sources.api_pages import api_items, crawl_audit, crawl_gaps, graphql_rows, next_page
from tidewell.sources.files import (
    broken_lines, infer_format, list_objects, read_csv, read_json_documents, read_ndjson, read_object, read_parquet,
)
from tidewell.sources.guards import guarded, settled
from tidewell.sources.lookup import key_lookup, time_window, write_lookup_table
from tidewell.sources.quarantine import judge_bounded_json, split_bounded_json
from tidewell.sources.resolve import read_source, register_source
from tidewell.sources.sql import all_text, check_read_only, read_jdbc, sql_query
from tidewell.sources.typing import apply_column_types, infer_column_types

__all__ = [
    "all_text", "api_items", "apply_column_types", "broken_lines", "check_read_only", "crawl_audit", "crawl_gaps", "graphql_rows", "guarded",
    "infer_column_types", "infer_format", "key_lookup", "list_objects", "next_page", "read_csv", "read_jdbc",
    "read_json_documents", "read_ndjson", "read_object", "read_parquet", "read_source", "register_source", "settled",
    "split_bounded_json", "sql_query", "time_window", "write_lookup_table",
]
