"""Files: CSV, NDJSON, JSON documents, Parquet, and object listings.

Paths are Hadoop URIs, so any configured object store works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewell.frame import col
from tidewell.functions.jsons import is_json_array, is_json_null, is_json_object, json_key
from tidewell.session import prepare

FORMATS = ("csv", "ndjson", "json", "parquet")
CORRUPT = "_corrupt_record"


def infer_format(path: Column) -> Column:
    """csv, ndjson or json by a path's extension."""
    lowered = F.lower(path)
    return (
        F.when(lowered.endswith(".csv"), "csv")
        .when(lowered.endswith(".ndjson") | lowered.endswith(".jsonl"), "ndjson")
        .otherwise("json")
    )


def _format_of(path: str) -> str:
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return "csv"
    if lowered.endswith((".ndjson", ".jsonl")):
        return "ndjson"
    if lowered.endswith(".parquet"):
        return "parquet"
    return "json"


def read_csv(spark: SparkSession, path: str | Sequence[str], delimiter: str = "", multi_line: bool = False) -> DataFrame:
    """A CSV with a header line; every column is text.

    An empty field is '', a field a short line lacks is null, and fields beyond
    the header are ignored. `multi_line` allows line breaks inside quotes; it
    keeps Spark from splitting large files, hence off by default.
    """
    separator = delimiter[:1] or ","

    def reader():
        return (
            spark.read.option("header", True).option("sep", separator).option("quote", '"')
            .option("escape", '"').option("multiLine", multi_line).option("inferSchema", False)
        )

    header = reader().csv(path).schema
    if not header.fields:
        return spark.createDataFrame([], header)
    # The reader gives null both for an empty and for a missing field. A line
    # with another number of fields is kept as a whole in an extra column;
    # its own field count then tells the two apart.
    raw = (
        reader().schema(T.StructType(list(header)).add(CORRUPT, "string"))
        .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        .option("enforceSchema", False).csv(path)
    )
    unquoted = F.regexp_replace(col(CORRUPT), '"[^"]*"', "")
    count = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1
    out = []
    for i, field in enumerate(header):
        present = F.when(col(CORRUPT).isNull() | (count > i), F.lit(""))
        out.append(F.coalesce(col(field.name), present).alias(field.name))
    return raw.select(*out)


def read_ndjson(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    quarantine: bool = False,
) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    A broken line fails the read, or with `quarantine` is kept as text in the
    column `_corrupt_record`. Without a schema Spark reads the data once more to
    infer it.
    """
    reader = spark.read
    if schema is None:
        schema = reader.option("mode", "PERMISSIVE" if quarantine else "FAILFAST").json(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not quarantine:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if CORRUPT not in schema.names:
        schema = T.StructType(list(schema)).add(CORRUPT, "string")
    return (
        spark.read.schema(schema).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def variant_rows(documents: DataFrame, document: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of VARIANT documents: items of an array, or the one value; none for null.

    Adds `pos` (position within the document) and `item` to the kept columns.
    """
    return documents.select(*[col(k) for k in keep], F.posexplode(_items(col(document))).alias("pos", "item"))


def _items(node: Column) -> Column:
    wrapped = (
        F.when(is_json_null(node), F.lit(None).cast("variant"))
        .when(is_json_array(node), node)
        .otherwise(F.to_variant_object(F.array(node)))
    )
    return F.try_variant_get(wrapped, "$", "array<variant>")


def item_columns(item: Column, schema: T.StructType) -> list[Column]:
    """Typed columns of a VARIANT row. A row that is no object is its column `value`."""
    out = []
    for field in schema:
        got = F.variant_get(item, "$" + json_key(field.name), field.dataType.simpleString())
        if field.name == "value":
            scalar = F.variant_get(F.when(~is_json_object(item), item), "$", field.dataType.simpleString())
            got = F.coalesce(got, scalar)
        out.append(got.alias(field.name))
    return out


def read_json_documents(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Files that hold one JSON document each.

    An array gives a row per item, an object one row, null none; scalar items
    become the column `value`, whether the schema has it or not. Without a schema the rows stay VARIANT, in `item`.
    With a schema Spark's JSON reader streams the documents, of any size, as long as all items are objects of its types; a
    document with other items is read as one VARIANT, of at most 128 MiB. Broken documents and values that have not
    the schema's type fail the read.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        documents = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("document"))
        return variant_rows(documents, "document").select("item")
    prepare(spark)  # no partial results: a document the reader cannot take as a whole comes as one row with its text
    text = "__document"
    raw = (
        spark.read.schema(T.StructType(list(schema)).add(text, "string")).option("multiLine", True)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", text).json(path)
    )
    taken = F.array(F.struct(*[col(f.name) for f in schema]))
    rest = F.transform(_items(F.parse_json(text)), lambda item: F.struct(*item_columns(item, schema)))
    return raw.select(F.inline(F.when(F.col(text).isNull(), taken).otherwise(rest)))


def broken_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """`file, line (from 1), text` of each line of NDJSON files that is no JSON object; blank lines count but are not broken.

    Lines are numbered in parallel: a first pass counts the lines of each file split, running sums give a split
    the lines before it, and only the broken lines are numbered. Both passes deal out the splits alike.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
    )
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    is_object = F.coalesce(is_json_object(F.try_parse_json("text")), F.lit(False))
    broken = lines.where((F.trim("text") != "") & ~is_object)
    return broken.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_object(
    spark: SparkSession,
    path: str,
    format: str = "",
    delimiter: str = "",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """An object of any supported format, by its extension unless named."""
    kind = format or _format_of(path)
    if kind == "csv":
        return read_csv(spark, path, delimiter, multi_line)
    if kind == "ndjson":
        return read_ndjson(spark, path, schema)
    if kind == "json":
        return read_json_documents(spark, path, schema)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported object format {kind!r}; known: {', '.join(FORMATS)}")


def list_objects(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Objects under a path: key, size, lastModified. Their content is not read."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive).load(path)
    )
    return listing.select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("lastModified")
    )
