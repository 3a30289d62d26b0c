"""File exports. Each writes a folder of part files, in parallel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from tidewell.frame import col
from tidewell.functions.text import cell_text, time_text

# Rows of one JSON array file. A result may have any number of such files.
ROWS_PER_ARRAY = 10_000
BYTES_PER_ARRAY = 64 << 20
COMPRESSIONS = ("snappy", "zstd", "gzip", "none")


def _write_lines(
    df: DataFrame, path: str, quote: Callable[[Column], Column], separator: str, line_end: str, max_rows: int | None, mode: str
) -> None:
    """Delimited text with a header in every part file.

    The text is composed by expressions: Spark's CSV writer would turn a line
    feed inside a cell into the line end, and quote a leading '#'.
    """
    header = F.concat_ws(separator, *[quote(F.lit(n)) for n in df.columns])
    cells = [quote(cell_text(col(f.name), f.dataType)) for f in df.schema]
    lines = df.limit(max_rows) if max_rows is not None else df
    written = Observation()
    # The low bits of this id count the rows of a task, which writes one file.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.concat_ws(separator, *cells)
    lines = lines.select(F.when(first, F.concat(header, F.lit(line_end), line)).otherwise(line).alias("value"))
    lines = lines.observe(written, F.count(F.lit(1)).alias("rows"))
    lines.write.mode(mode).option("lineSep", line_end).text(path)
    if written.get["rows"] == 0:
        only_header = df.sparkSession.range(1).coalesce(1).select(header.alias("value"))
        only_header.write.mode("append").option("lineSep", line_end).text(path)


def write_csv(df: DataFrame, path: str, max_rows: int | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header, CRLF line ends, and quotes only where a cell needs them.

    Null is an empty cell, nested values are JSON text.
    """

    def quote(cell: Column) -> Column:
        doubled = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(cell.rlike(r'[",\n\r]'), doubled).otherwise(cell)

    _write_lines(df, path, quote, ",", "\r\n", max_rows, mode)


def write_tsv(df: DataFrame, path: str, max_rows: int | None = None, mode: str = "errorifexists") -> None:
    """Tab-separated cells without any quoting, LF line ends."""
    _write_lines(df, path, lambda cell: cell, "\t", "\n", max_rows, mode)


def _json_ready(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        c = col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = time_text(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(
    df: DataFrame, path: str, max_rows: int | None = None, compression: str = "none", mode: str = "errorifexists"
) -> None:
    """One JSON object per line and row, keys in column order, nulls kept."""
    ready = _json_ready(df.limit(max_rows) if max_rows is not None else df)
    ready.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gzip-compressed JSON lines."""
    write_json(df, path, compression="gzip", mode=mode)


def write_json_array(
    df: DataFrame, path: str, rows_per_file: int = ROWS_PER_ARRAY, mode: str = "errorifexists", order_by: Sequence[str] = (),
    bytes_per_file: int = BYTES_PER_ARRAY,
) -> None:
    """JSON arrays, one in each file, of at most `rows_per_file` rows and about `bytes_per_file` bytes (or one longer row), written in parallel.

    Every file is a JSON document by itself. With `order_by` the rows of the files, in
    the order of their names, are sorted. A table without rows gives one empty array.
    """
    if rows_per_file < 1 or bytes_per_file < 1:
        raise ValueError("a JSON array file needs room for a row")
    ready = _json_ready(df.orderBy(*[col(c) for c in order_by]) if order_by else df)
    text = F.to_json(F.struct(*[col(c) for c in ready.columns]), {"ignoreNullFields": "false"})
    # The id has the task's number and the row's number in the task: rows of one file are neighbours.
    place = F.monotonically_increasing_id()
    numbered = ready.select(text.alias("row"), place.alias("at"))
    low = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumns({"task": F.shiftright("at", 33), "number": F.floor(low / rows_per_file)})
    before = Window.partitionBy("task", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum(F.octet_length("row") + 1).over(before), F.lit(0)) / F.lit(bytes_per_file))
    chunk = F.struct("task", "number", "part")
    arrays = numbered.withColumn("part", part).groupBy(chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("rows"))
    lines = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]"))
    written = Observation()
    out = arrays.orderBy("chunk").select(lines.alias("value")).observe(written, F.count(F.lit(1)).alias("arrays"))
    out.write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    if written.get["arrays"] == 0:
        df.sparkSession.range(1).coalesce(1).select(F.lit("[]").alias("value")).write.mode("append").text(path)


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
    mode: str = "errorifexists",
) -> None:
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compression!r}; known: {', '.join(COMPRESSIONS)}")
    writer = df.write.mode(mode).option("compression", compression)
    if max_records_per_file > 0:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
