"""The exchange envelope: schema and meta beside the rows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession, types as T

from tidewell.frame import Frame, Meta, logical_type


def write_envelope(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines in `rows/`; schema and meta as one document in `envelope/`."""
    df = frame.df
    df.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/rows")
    fields = [
        {"name": f.name, "type": logical_type(f.dataType), "nullable": f.nullable} for f in df.schema
    ]
    document = {"schema": {"fields": fields}, "meta": frame.meta.to_dict(), "rowType": df.schema.jsonValue()}
    text = df.sparkSession.createDataFrame([(json.dumps(document),)], "value string")
    text.coalesce(1).write.mode(mode).text(f"{path}/envelope")


def read_envelope(spark: SparkSession, path: str) -> Frame:
    document = json.loads(spark.read.text(f"{path}/envelope", wholetext=True).first()["value"])
    schema = T.StructType.fromJson(document["rowType"])
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")
    return Frame(df, Meta.from_dict(document["meta"]))
