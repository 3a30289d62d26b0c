"""Row limits, sorting and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.frame import Frame, col, literal_like, require

# Query row limit and page size, defaults and the ceilings that hold unless a caller gives another.
DEFAULT_ROW_LIMIT = 1_000
MAX_ROW_LIMIT = 10_000
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200


def effective_row_limit(requested: int | None, maximum: int = MAX_ROW_LIMIT) -> int:
    """The limit asked for, or the default; an error above `maximum`, which callers may raise."""
    if not requested or requested <= 0:
        return min(DEFAULT_ROW_LIMIT, maximum)
    if requested > maximum:
        raise ValueError(f"a limit of {requested} rows is above the maximum of {maximum}")
    return requested


def page_size(requested: int | None, maximum: int = MAX_PAGE_SIZE) -> int:
    """The page size asked for, or the default; an error above `maximum`, which callers may raise."""
    if not requested or requested <= 0:
        return min(DEFAULT_PAGE_SIZE, maximum)
    if requested > maximum:
        raise ValueError(f"a page of {requested} rows is above the maximum of {maximum}")
    return requested


def row_limit(
    frame: Frame, requested: int | None = None, order_by: Sequence[Column | str] = (), maximum: int = MAX_ROW_LIMIT
) -> Frame:
    """At most the limit of rows (default `DEFAULT_ROW_LIMIT`), with `truncated` set when there were more.

    Runs a job: it looks for one row beyond the limit, which the limit bounds.
    """
    limit = effective_row_limit(requested, maximum)
    df = frame.df.orderBy(*order_by) if order_by else frame.df
    truncated = df.offset(limit).limit(1).count() > 0
    return Frame(df.limit(limit), frame.meta).with_meta(truncated=frame.meta.truncated or truncated)


def head(df: DataFrame, n: int, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """The first n rows in a given order (a top-k, not a full sort). All rows for n <= 0."""
    ordered = df.orderBy(*order_by) if order_by else df
    return ordered.limit(n) if n > 0 else ordered


def sort_rows(df: DataFrame, column: str, direction: str | None) -> DataFrame:
    """Sort by one column: "asc", "desc" or None for source order."""
    require(df, column)
    if direction is None:
        return df
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown sort direction {direction!r}")
    return df.orderBy(col(column).asc() if direction == "asc" else col(column).desc())


def matching(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    time_column: str | None = None,
    since: Any = None,
    until: Any = None,
) -> DataFrame:
    """AND-ed optional filters. Values that are None or '' do not filter."""
    out = df
    for name, value in (equals or {}).items():
        require(df, name)
        if value is not None and value != "":
            out = out.where(col(name) == F.lit(value))
    if since is not None:
        out = out.where(col(time_column) >= literal_like(df, time_column, since))
    if until is not None:
        out = out.where(col(time_column) <= literal_like(df, time_column, until))
    return out


def page(
    df: DataFrame,
    newest_first: Sequence[str],
    limit: int | None = None,
    offset: int = 0,
    before: Sequence[Any] | None = None,
    maximum: int = MAX_PAGE_SIZE,
) -> DataFrame:
    """One page, newest first; nulls come last.

    `newest_first` names the sort columns, most significant first; the last one
    should be unique. `before` continues after the last row of the page
    before it (a value per sort column, null included): unlike a deep `offset`, this
    filters and never carries skipped rows along.
    """
    require(df, *newest_first)
    out = df
    if before is not None:
        out = out.where(_after(df, newest_first, before))
    out = out.orderBy(*[col(c).desc() for c in newest_first])
    if offset > 0:
        out = out.offset(offset)
    return out.limit(page_size(limit, maximum))


def _after(df: DataFrame, names: Sequence[str], values: Sequence[Any]) -> Column:
    """Whether a row comes after the given one in the page order: smaller, or null where that is not."""
    if values[0] is None:
        later, same = F.lit(False), col(names[0]).isNull()
    else:
        first = literal_like(df, names[0], values[0])
        later, same = (col(names[0]) < first) | col(names[0]).isNull(), col(names[0]).eqNullSafe(first)
    return later if len(names) == 1 else later | (same & _after(df, names[1:], values[1:]))
