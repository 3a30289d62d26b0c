"""Key lookups and time windows over tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from tidewell.frame import col, literal_like, require
from tidewell.operators.project import filter_rows


def key_lookup(
    df: DataFrame, key_condition: str = "", filter: str = "", scan: bool = False, limit: int | None = None
) -> DataFrame:
    """Rows for a key condition, or with `scan` of the whole table, then filtered.

    Both conditions reach the scan: partition folders and row-group statistics
    serve the key condition.
    """
    if not scan and not key_condition:
        raise ValueError("lookup needs a key condition (or scan=True for the whole table)")
    out = df if scan else filter_rows(df, key_condition)
    if filter:
        out = filter_rows(out, filter)
    return out if limit is None else out.limit(limit)


def write_lookup_table(df: DataFrame, path: str, key: str, rows_per_page: int = 1000) -> None:
    """A table laid out for lookups by `key`: files hold ranges of the key in order, with Bloom filters on it.

    A lookup then skips files and row groups by their ranges, row groups that have the key's range but not the key by the filter, and
    pages by theirs. A key with very many rows spreads over files: the order goes on by the row's hash.
    """
    require(df, key)
    rest = F.xxhash64(*[col(c) for c in df.columns if c != key]) if len(df.columns) > 1 else F.lit(0)
    laid = df.repartitionByRange(col(key), rest).sortWithinPartitions(col(key))
    writer = laid.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.page.row.count.limit", str(rows_per_page))
    writer.parquet(path)


def time_window(
    df: DataFrame, column: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Rows within [start, end]; by default the last hour up to now.

    Append several tables with `concat` first when a source has more than one.
    """
    end = end or datetime.now(timezone.utc)
    start = start or end - timedelta(hours=1)
    return df.where(col(column).between(literal_like(df, column, start), literal_like(df, column, end)))
