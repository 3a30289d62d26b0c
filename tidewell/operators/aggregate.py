"""Grouping with the five basic aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.frame import col, dtype_of, is_numeric, require

OPS = ("sum", "avg", "count", "min", "max")


@dataclass(frozen=True)
class Agg:
    """One aggregate: `op` over `field`, named `name` or `<op>_<field>`."""

    op: str
    field: str = ""
    name: str = ""

    @property
    def out_name(self) -> str:
        return self.name or f"{self.op}_{self.field}"


def _aggregate(df: DataFrame, agg: Agg) -> Column:
    if agg.op not in OPS:
        raise ValueError(f"unknown aggregate {agg.op!r}; known: {', '.join(OPS)}")
    if agg.op == "count":
        return F.count(F.lit(1))
    dtype = dtype_of(df, agg.field)
    if not is_numeric(dtype):
        return F.lit(0.0)
    value = col(agg.field).cast("double")
    if agg.op in ("min", "max"):
        # NaN sorts above every number in Spark; it is no bound here.
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        return F.coalesce(F.min(value) if agg.op == "min" else F.max(value), F.lit(0.0))
    return F.coalesce(F.sum(value) if agg.op == "sum" else F.avg(value), F.lit(0.0))


def group_by(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], ordered: bool = False) -> DataFrame:
    """Group rows and aggregate.

    sum/avg/min/max are doubles over the non-null numbers, 0 when a group has
    none; count counts rows. Without keys an empty table gives no row.
    `ordered` sorts the groups by their keys as text, which costs a global sort.
    """
    require(df, *keys)
    names = [*keys, *(a.out_name for a in aggs)]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"output columns would repeat: {repeated}")

    columns = [_aggregate(df, a).alias(a.out_name) for a in aggs]
    if not keys:
        if not columns:
            raise ValueError("aggregate needs a key or an aggregation")
        out = df.agg(*columns, F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows")
        return out
    # A VARIANT cannot be grouped; its JSON text stands for it.
    grouping = [
        (F.to_json(col(k)) if isinstance(dtype_of(df, k), T.VariantType) else col(k)).alias(k) for k in keys
    ]
    grouped = df.groupBy(*grouping)
    # An aggregate over a column without numbers is a plain constant.
    out = grouped.agg(*columns) if columns else df.select(*grouping).distinct()
    return order_groups(out, keys) if ordered else out


def order_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sort groups by their keys as text, nulls first: 10 comes before 9."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("\x00null")) for k in keys]
    return df.orderBy(F.concat_ws("\x1f", *parts))
