"""Chart input rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.frame import is_numeric, logical_type


def chart_number(value: Column, dtype: T.DataType) -> Column:
    """A finite number, from a number or from numeric text; else null."""
    if is_numeric(dtype):
        number = value.cast("double")
    elif isinstance(dtype, T.StringType):
        # Java's number reader also takes suffixes such as 1d and 2f.
        plain = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$", 1)
        number = F.when(plain != "", plain.cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def chartable_fields(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, columns usable as a dimension)."""
    kinds = [(f.name, logical_type(f.dataType)) for f in df.schema]
    numeric = [n for n, k in kinds if k in ("int64", "float64")]
    categorical = [n for n, k in kinds if k not in ("json", "null")]
    return numeric, categorical


@dataclass(frozen=True)
class ChartConfig:
    kind: str
    x: str
    y: tuple[str, ...]


def default_chart(df: DataFrame) -> ChartConfig:
    """What a table is charted as before anyone chooses."""
    numeric, categorical = chartable_fields(df)
    x = categorical[0] if categorical else (df.columns[0] if df.columns else "")
    return ChartConfig("line" if len(numeric) > 1 else "bar", x, tuple(numeric[:2]))
