"""Equi-joins with null-safe keys and collision prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.frame import col, dtype_of, is_numeric, logical_type, require
from tidewell.session import fits_broadcast

DEFAULT_RIGHT_PREFIX = "right_"
JOIN_TYPES = ("inner", "left", "right", "outer")


def join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    right_prefix: str = DEFAULT_RIGHT_PREFIX,
    split_outer: bool | None = None,
) -> DataFrame:
    """Join two tables on one key pair; null keys match null keys.

    Every column of both sides is kept. A right column whose name the left
    side has gets `right_prefix`.

    Adaptive execution splits a hot key of an inner join on either side, but of
    a left or right join only on the kept side, and of a full join not at all.
    `split_outer` therefore plans an outer join as the inner join plus the rows
    without partner (an anti-join against the *distinct* keys of the other
    side, which has no hot key left). By default this is done whenever the
    other side is too large for a broadcast.
    """
    if not left_key or not right_key:
        raise ValueError("join needs a left and a right key")
    how = how or "inner"
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; known: {', '.join(JOIN_TYPES)}")
    require(left, left_key)
    require(right, right_key)
    _check_key_types(left, right, left_key, right_key)

    renamed = _prefixed_names(left, right, right_prefix or DEFAULT_RIGHT_PREFIX)
    right = right.select(*[col(c).alias(renamed[c]) for c in right.columns])
    key = renamed[right_key]

    if how == "inner":
        return _equi(left, right, left_key, key, "inner")
    if split_outer is None:
        split_outer = _hot_side_unsplittable(left, right, how)
    if not split_outer:
        return _equi(left, right, left_key, key, how)

    out = _equi(left, right, left_key, key, "inner")
    names = [*left.columns, *right.columns]
    if how in ("left", "outer"):
        lone = _without_partner(left, left_key, right, key)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
        out = out.unionAll(lone.select(*[col(c) for c in left.columns], *nulls))
    if how in ("right", "outer"):
        lone = _without_partner(right, key, left, left_key)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema]
        out = out.unionAll(lone.select(*nulls, *[col(c) for c in right.columns]))
    return out.select(*[col(n) for n in names])


def _equi(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    return left.join(right, col(left_key).eqNullSafe(col(right_key)), how)


def _without_partner(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    keys = other.select(col(other_key).alias("__partner_key")).distinct()
    return df.join(keys, col(key).eqNullSafe(F.col("__partner_key")), "left_anti")


def _hot_side_unsplittable(left: DataFrame, right: DataFrame, how: str) -> bool:
    if left.isStreaming or right.isStreaming:
        return False
    if how == "left":
        return not fits_broadcast(right)
    if how == "right":
        return not fits_broadcast(left)
    return not (fits_broadcast(left) and fits_broadcast(right))


def _check_key_types(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> None:
    a, b = dtype_of(left, left_key), dtype_of(right, right_key)
    if is_numeric(a) and is_numeric(b):
        return
    kinds = {logical_type(a), logical_type(b)} - {"null"}
    if len(kinds) > 1:
        raise TypeError(f"join keys have unlike types: {left_key} is {a.simpleString()}, {right_key} is {b.simpleString()}")
    if "json" in kinds:
        raise TypeError("join keys must be scalar columns")


def _prefixed_names(left: DataFrame, right: DataFrame, prefix: str) -> dict[str, str]:
    taken = set(left.columns)
    names = {c: prefix + c if c in taken else c for c in right.columns}
    for name in names.values():
        if name in taken:
            raise ValueError(f"column {name!r} exists on both sides even with the prefix {prefix!r}")
        taken.add(name)
    return names
