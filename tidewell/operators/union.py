"""Append tables whose columns differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.frame import cast_to, col, widen


def concat(*tables: DataFrame | None) -> DataFrame:
    """Rows of all tables, matched by column name.

    A column a table lacks is null there. Types are widened (see `widen`):
    integers and floats meet as double, unlike kinds as VARIANT. Columns come
    in the order they are first seen; missing tables are skipped.
    """
    present = [t for t in tables if t is not None]
    if not present:
        raise ValueError("concat needs a table")
    types: dict[str, T.DataType] = {}
    for table in present:
        for f in table.schema:
            types[f.name] = widen(types[f.name], f.dataType) if f.name in types else f.dataType

    aligned = []
    for table in present:
        have = {f.name: f.dataType for f in table.schema}
        aligned.append(
            table.select(
                *[
                    (cast_to(col(n), have[n], t) if n in have else F.lit(None).cast(t)).alias(n)
                    for n, t in types.items()
                ]
            )
        )
    return reduce(DataFrame.unionAll, aligned)
