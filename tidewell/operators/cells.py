"""Cell size limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.frame import col

# Default cell limits in bytes and the marker put after a cut.
DEFAULT_MAX_STRING_BYTES = 1024 * 1024
DEFAULT_MAX_BINARY_BYTES = 5 * 1024 * 1024
CUT_MARKER = "…(truncated)"


def _cut_text(column: Column, max_bytes: int) -> Column:
    """The longest whole-character start of a string within a byte limit."""
    raw = column.cast("binary")
    # A UTF-8 character has at most four bytes: one of these four is whole.
    starts = [
        F.try_validate_utf8(F.substring(raw, 1, max_bytes - back).cast("string"))
        for back in range(4)
        if max_bytes - back >= 0
    ]
    return F.coalesce(*starts)


def truncate_cells(
    df: DataFrame,
    max_string_bytes: int = DEFAULT_MAX_STRING_BYTES,
    max_binary_bytes: int = DEFAULT_MAX_BINARY_BYTES,
) -> DataFrame:
    """Cut long strings (with a marker) and long binaries (without)."""
    out = []
    for field in df.schema:
        c = col(field.name)
        if isinstance(field.dataType, T.StringType) and max_string_bytes > 0:
            cut = F.concat(_cut_text(c, max_string_bytes), F.lit(CUT_MARKER))
            c = F.when(F.octet_length(c) > max_string_bytes, cut).otherwise(c)
        elif isinstance(field.dataType, T.BinaryType) and max_binary_bytes > 0:
            c = F.when(F.octet_length(c) > max_binary_bytes, F.substring(c, 1, max_binary_bytes)).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def count_long_cells(
    df: DataFrame,
    max_string_bytes: int = DEFAULT_MAX_STRING_BYTES,
    max_binary_bytes: int = DEFAULT_MAX_BINARY_BYTES,
) -> DataFrame:
    """One row `affected`: how many cells the limits would cut."""
    return df.agg(F.coalesce(long_cells(df, max_string_bytes, max_binary_bytes), F.lit(0).cast("long")).alias("affected"))


def long_cells(
    df: DataFrame,
    max_string_bytes: int = DEFAULT_MAX_STRING_BYTES,
    max_binary_bytes: int = DEFAULT_MAX_BINARY_BYTES,
) -> Column:
    """An aggregate: how many cells the limits would cut."""
    total = F.sum(F.lit(0).cast("long"))
    for field in df.schema:
        limit = {T.StringType: max_string_bytes, T.BinaryType: max_binary_bytes}.get(type(field.dataType), 0)
        if limit > 0:
            total = total + F.count_if(F.octet_length(col(field.name)) > limit)
    return total


def cell_warning(affected: int) -> str:
    return f"{affected} cell(s) exceeded per-type cell limits and were truncated"
