"""The table contract: a DataFrame with provenance beside it, and its types."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


class UnknownColumnError(ValueError):
    """An operation names a column that the table does not have."""

    def __init__(self, name: str):
        super().__init__(f'unknown column "{name}"')
        self.name = name


@dataclass(frozen=True)
class Meta:
    """Provenance and quality notes of a table. Never filled by a hidden job."""

    name: str = ""
    source_type: str = ""
    source_id: str = ""
    lineage: tuple[str, ...] = ()
    generated_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    duration_ms: int | None = None
    row_count: int | None = None
    column_count: int | None = None
    truncated: bool = False
    warnings: tuple[str, ...] = ()
    extra: Mapping[str, Any] = field(default_factory=dict)

    def warn(self, message: str) -> Meta:
        return replace(self, warnings=(*self.warnings, message))

    def to_dict(self) -> dict[str, Any]:
        """The JSON form: optional fields are left out when empty."""
        out: dict[str, Any] = {"generatedAt": self.generated_at.isoformat(), "truncated": self.truncated}
        optional = {
            "name": self.name,
            "sourceType": self.source_type,
            "sourceId": self.source_id,
            "lineage": list(self.lineage),
            "durationMs": self.duration_ms,
            "rowCount": self.row_count,
            "columnCount": self.column_count,
            "warnings": list(self.warnings),
            "extra": dict(self.extra),
        }
        out.update({k: v for k, v in optional.items() if v not in (None, "", [], {})})
        return out

    @staticmethod
    def from_dict(data: Mapping[str, Any]) -> Meta:
        return Meta(
            name=data.get("name", ""),
            source_type=data.get("sourceType", ""),
            source_id=data.get("sourceId", ""),
            lineage=tuple(data.get("lineage", ())),
            generated_at=datetime.fromisoformat(data["generatedAt"]),
            duration_ms=data.get("durationMs"),
            row_count=data.get("rowCount"),
            column_count=data.get("columnCount"),
            truncated=data.get("truncated", False),
            warnings=tuple(data.get("warnings", ())),
            extra=data.get("extra", {}),
        )


@dataclass(frozen=True)
class Frame:
    """`watch` gives notes that are known once the rows were read (see `sources.guards`)."""

    df: DataFrame
    meta: Meta = field(default_factory=Meta)
    watch: Any = None

    def with_meta(self, **changes: Any) -> Frame:
        return replace(self, meta=replace(self.meta, **changes))


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise UnknownColumnError(name)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def expr_dtype(df: DataFrame, expression: Column) -> T.DataType:
    """The type an expression has over this table. Analysis only, no job."""
    return df.select(expression.alias("e")).schema[0].dataType


def literal_like(df: DataFrame, column: str, value: Any) -> Column:
    """A constant to compare a column with.

    Moments without zone are UTC, on a column of either timestamp type and
    whatever zone this process runs in.
    """
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(dtype_of(df, column))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def logical_type(dtype: T.DataType) -> str:
    """The exploration type name shown to users."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, INTEGRAL):
        return "int64"
    if is_numeric(dtype):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, TIMES):
        return "time"
    if isinstance(dtype, T.NullType):
        return "null"
    return "json"


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The common type of two columns; unlike kinds become VARIANT, never text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL):
        return T.LongType()
    if is_numeric(a) and is_numeric(b):
        return T.DoubleType()
    if isinstance(a, T.StringType) and isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, TIMES) and isinstance(b, TIMES):
        return T.TimestampType()
    return T.VariantType()


def cast_to(column: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return column
    if isinstance(target, T.VariantType) and isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(column)
    return column.cast(target)
