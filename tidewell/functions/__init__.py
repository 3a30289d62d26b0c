"""Column functions. All of them are plain Spark expressions."""

from tidewell.functions.chart import chart_number, chartable_fields, default_chart
from tidewell.functions.classify import (
    classify_code, classify_error, error_trip_kind, soft_limit_bucket, trip_kinds, warning_trip_kind,
)
from tidewell.functions.jsons import bounded_json_verdict, cursor_text, json_path
from tidewell.functions.text import bytes_text, cell_text, number_text, query_hash, query_summary, time_text, uuid_text

__all__ = [
    "bounded_json_verdict", "bytes_text", "cell_text", "chart_number", "chartable_fields", "classify_code",
    "classify_error", "cursor_text", "default_chart", "error_trip_kind", "json_path", "number_text", "query_hash",
    "query_summary", "soft_limit_bucket", "time_text", "trip_kinds", "uuid_text", "warning_trip_kind",
]
