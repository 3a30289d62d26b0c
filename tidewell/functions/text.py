"""Text forms of values and of queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tidewell.frame import NESTED


def uuid_text(raw: Column) -> Column:
    """Sixteen bytes as the canonical 8-4-4-4-12 text."""
    digits = F.lower(F.hex(raw))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def bytes_text(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def number_text(value: Column) -> Column:
    """A double the way JSON and script consoles print it: 1, 0.5, 12345678.5, 1e-7."""
    text = value.cast("string")
    size = F.abs(value)
    plain_large = text.try_cast(T.DecimalType(38, 16)).cast("string")
    plain_small = text.try_cast(T.DecimalType(38, 23)).cast("string")
    trimmed = F.regexp_replace(F.when(size >= 1, plain_large).otherwise(plain_small), r"\.?0+$", "")
    # Spark prints 1.0E-7 and 1.5E22 where the short form is 1e-7 and 1.5e+22.
    exponent = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.0e", "e"), r"e(\d)", "e+$1")
    return (
        F.when(value == 0, F.lit("0"))
        .when(F.isnan(value), F.lit("NaN"))
        .when(size == float("inf"), text)
        .when((size >= 1e-6) & (size < 1e21), trimmed)
        .otherwise(exponent)
    )


def time_text(value: Column, dtype: T.DataType) -> Column:
    """RFC 3339 in UTC, without trailing zeros in the fraction, whatever the session's time zone.

    Moments without a zone are taken as UTC.
    """
    if isinstance(dtype, T.DateType):
        return value.cast("string")
    if isinstance(dtype, T.TimestampType):
        seconds = (F.unix_micros(value).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        none = F.lit(0)
        value = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(none, none, none, seconds)
    return F.concat(F.replace(value.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """A cell as shown and exported: '' for null, JSON text for nested values."""
    if isinstance(dtype, NESTED):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = number_text(value.cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = time_text(value, dtype)
    elif isinstance(dtype, T.BinaryType):
        text = F.base64(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def query_summary(query: Column, length: int = 80) -> Column:
    """A query on one line, cut to its first characters."""
    trimmed = F.regexp_replace(query, r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(trimmed, r"\s+", " "), 1, length)


# Quoted text, comments, and everything between them.
_SQL_PIECES = r"""'[^']*'|"[^"]*"|--[^\n]*|/\*[\s\S]*?\*/|[^'"/-]+|[-/'"]"""


def query_hash(query: Column) -> Column:
    """A hash equal for queries that differ in blanks, comments and a last ';' only.

    Comment marks inside quoted text are left alone.
    """
    pieces = F.regexp_extract_all(query, F.lit(_SQL_PIECES), F.lit(0))
    is_comment = lambda p: p.startswith("--") | p.startswith("/*")
    no_comments = F.array_join(F.transform(pieces, lambda p: F.when(is_comment(p), " ").otherwise(p)), "")
    collapsed = F.regexp_replace(no_comments, r"\s+", " ")
    return F.sha2(F.regexp_replace(collapsed, r"^ +|[ ;]+$", ""), 256)
