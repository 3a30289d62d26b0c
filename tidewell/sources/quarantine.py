"""Keep malformed or oversized JSON payloads apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.frame import col
from tidewell.functions.jsons import MAX_DEPTH, MAX_TOKENS, bounded_json_verdict


def judge_bounded_json(df: DataFrame, column: str, max_depth: int = MAX_DEPTH, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All rows with the `reason` for which a payload is refused, null for a valid one. One pass."""
    return df.withColumn("reason", bounded_json_verdict(col(column), max_depth, max_tokens))


def split_bounded_json(
    df: DataFrame, column: str, max_depth: int = MAX_DEPTH, max_tokens: int = MAX_TOKENS, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, refused rows with the `reason`).

    The two are judged apart when each is computed. With a `folder` the judged rows are written there
    first, apart by verdict, so each payload is judged once.
    """
    judged = judge_bounded_json(df, column, max_depth, max_tokens)
    if folder:
        refused = F.col("reason").isNotNull()
        judged.withColumn("refused", refused).write.partitionBy("refused").parquet(folder)
        judged = df.sparkSession.read.schema(judged.schema.add("refused", T.BooleanType())).parquet(folder)
        return judged.where("NOT refused").drop("reason", "refused"), judged.where("refused").drop("refused")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
