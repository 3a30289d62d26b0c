"""Projection and filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.frame import Frame, col, expr_dtype, is_numeric

DEFAULT_MAX_COLUMNS = 512


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the order given; names the table lacks are ignored."""
    have = set(df.columns)
    return df.select(*[col(n) for n in names if n in have])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename some columns, keeping the others. Two columns of one name are refused."""
    after = [names.get(c, c) for c in df.columns]
    clashes = sorted({n for n in after if after.count(n) > 1})
    if clashes:
        raise ValueError(f"rename would repeat column names: {clashes}")
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def truthy(column: Column, dtype: T.DataType) -> Column:
    """True or false for any value: null, false, 0, '' and an empty array are false."""
    return F.coalesce(_predicate(column, dtype), F.lit(False))


def _predicate(column: Column, dtype: T.DataType) -> Column:
    # Null counts as false in a WHERE, so the bare comparison is left as it
    # is there: scans can push it down, which a coalesce() would prevent.
    if isinstance(dtype, T.BooleanType):
        return column
    if is_numeric(dtype):
        return column != 0
    if isinstance(dtype, T.StringType):
        return column != ""
    if isinstance(dtype, T.ArrayType):
        return F.size(column) > 0
    if isinstance(dtype, T.NullType):
        return F.lit(False)
    return column.isNotNull()


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Keep the rows for which a Spark SQL expression is truthy."""
    if not expression or not expression.strip():
        raise ValueError("filter needs an expression")
    condition = F.expr(expression)
    return df.where(_predicate(condition, expr_dtype(df, condition)))


def transform(df: DataFrame, shape: Mapping[str, str] | str) -> DataFrame:
    """Give every row a new shape.

    `shape` is either {column: expression}, or one expression. An expression
    that yields a struct becomes the new row; anything else is wrapped in a
    column named `value`.
    """
    if not shape:
        raise ValueError("transform needs an expression")
    if isinstance(shape, Mapping):
        return df.select(*[F.expr(e).alias(name) for name, e in shape.items()])
    value = F.expr(shape)
    wrapped = df.select(value.alias("value"))
    if isinstance(wrapped.schema[0].dataType, T.StructType):
        return wrapped.select("value.*")
    return wrapped


def limit_columns(frame: Frame, max_columns: int = DEFAULT_MAX_COLUMNS) -> Frame:
    """Keep the first columns only, and say so."""
    names = frame.df.columns
    if max_columns <= 0 or len(names) <= max_columns:
        return frame
    meta = frame.meta.warn(f"Column cap reached at {max_columns} columns.")
    kept = frame.df.select(*[col(n) for n in names[:max_columns]])
    return Frame(kept, meta).with_meta(truncated=True, column_count=max_columns)
