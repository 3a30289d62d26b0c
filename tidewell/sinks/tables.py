"""Append to a table of an external database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def append_table(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, connections: int = 8
) -> None:
    """Insert all rows over at most `connections` parallel JDBC connections.

    Needs the database's JDBC driver on the class path.
    """
    df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option(
        "numPartitions", str(connections)
    ).options(**dict(properties or {})).save()
