"""Column types: inference over text columns, and declared overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.frame import col, require, string_columns

# Declared type names and the Spark type each stands for.
COLUMN_TYPES = {
    "int": "bigint", "float": "double", "date": "date", "datetime": "timestamp_ntz", "bool": "boolean",
    "string": "string", "bytes": "binary",
}
# The kinds a value can have, each with a test of the text `@c` and a bit. The
# first that holds counts; text of no kind has the bit after them. A failing
# try_cast is slow (it catches an exception), so shape decides first. Numbers with
# leading zeros are codes and stay text.
_KINDS = (
    (
        "int",
        "@c RLIKE '^[+-]?(0|[1-9][0-9]{0,17})$' OR (@c RLIKE '^[+-]?[1-9][0-9]{18}$' AND try_cast(@c AS BIGINT) IS NOT NULL)",
    ),
    ("float", "@c RLIKE '^[+-]?((0|[1-9][0-9]*)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"),
    ("bool", "lower(@c) IN ('true', 'false')"),
    (
        "date",
        "octet_length(@c) = 10 AND @c RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND try_cast(@c AS DATE) IS NOT NULL",
    ),
    (
        "datetime",
        "octet_length(@c) >= 16 AND @c RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?$' "
        "AND try_cast(@c AS TIMESTAMP_NTZ) IS NOT NULL",
    ),
)
_TEXT_BIT = 1 << len(_KINDS)
# Most text is told by its first character, without a pattern.
_KIND_BIT = (
    f"CASE WHEN @c IS NULL THEN NULL WHEN instr('+-.0123456789tTfF', substr(@c, 1, 1)) = 0 OR @c = '' THEN {_TEXT_BIT} "
    + " ".join(f"WHEN {test} THEN {1 << i}" for i, (_, test) in enumerate(_KINDS))
    + f" ELSE {_TEXT_BIT} END"
)
# A column is of one kind, or of integers and floats.
_TYPE_OF_BITS = {1 << i: kind for i, (kind, _) in enumerate(_KINDS)} | {0b11: "float"}
_TYPE_CASES = " ".join(f"WHEN {bits} THEN '{kind}'" for bits, kind in _TYPE_OF_BITS.items())
def infer_column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`name, type, non_null` per text column, in one scan; a row per task and column in the shuffle.

    A column mixing kinds (or without values) is a string column, and so is one with
    zero-padded numbers. Integers are those of 64 bits; longer ones make a float column.
    """
    names = list(columns) if columns is not None else string_columns(df)
    require(df, *names)
    if not names:
        raise ValueError("no text column to infer a type for")
    # Cells one below the other: the test of a kind is compiled once, however many columns there are.
    cells = F.array(*[F.struct(F.lit(i).alias("at"), col(n).alias("cell")) for i, n in enumerate(names)])
    bits = df.select(F.inline(cells)).withColumn("bit", F.expr(_KIND_BIT.replace("@c", "cell")))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"), F.count("bit").alias("non_null"))
    listed = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("name")) for i, n in enumerate(names)])))
    out = listed.join(found, F.col("no") == F.col("at"), "left")
    return out.select("name", F.expr(f"CASE bits {_TYPE_CASES} ELSE 'string' END").alias("type"), F.coalesce("non_null", F.lit(0).cast("long")).alias("non_null"))


def apply_column_types(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the declared types, rows where a value does not convert).

    A refused row keeps its text and names the columns at fault in
    `bad_columns`.
    """
    require(df, *types)
    unknown = sorted(set(types.values()) - set(COLUMN_TYPES))
    if unknown:
        raise ValueError(f"unknown column types {unknown}; known: {', '.join(COLUMN_TYPES)}")
    cast = {n: col(n).try_cast(COLUMN_TYPES[t]) for n, t in types.items()}
    faults = [F.when(col(n).isNotNull() & c.isNull(), F.lit(n)) for n, c in cast.items()]
    bad = F.array_compact(F.array(*faults))
    good = df.where(F.size(bad) == 0).select(*[cast.get(n, col(n)).alias(n) for n in df.columns])
    return good, df.where(F.size(bad) > 0).withColumn("bad_columns", bad)


def declared_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows with the declared types; a value that does not convert fails the read and names its column. An empty text is null, unless text is declared."""
    require(df, *types)
    unknown = sorted(set(types.values()) - set(COLUMN_TYPES))
    if unknown:
        raise ValueError(f"unknown column types {unknown}; known: {', '.join(COLUMN_TYPES)}")
    out = []
    for name in df.columns:
        if name not in types:
            out.append(col(name))
            continue
        given = F.nullif(col(name), F.lit("")) if df.schema[name].dataType == T.StringType() and types[name] not in ("string", "bytes") else col(name)
        cast = given.try_cast(COLUMN_TYPES[types[name]])
        fault = F.raise_error(F.concat(F.lit(f"column {name}: no {types[name]}: "), F.substring(col(name).cast("string"), 1, 80)))
        out.append(F.when(given.isNotNull() & cast.isNull(), fault.cast(COLUMN_TYPES[types[name]])).otherwise(cast).alias(name))
    return df.select(*out)
