"""SQL over registered tables and external databases."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewell.frame import col

# Words a read-only query must not contain.
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke", "create", "replace", "merge",
    "call", "exec", "execute", "vacuum", "copy",
)
# Functions through which a query could call into the JVM.
JVM_FUNCTIONS = ("reflect", "try_reflect", "java_method")
_REFUSED = re.compile(rf"\b(?:{'|'.join(FORBIDDEN_WORDS)})\b", re.IGNORECASE)


def check_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """The query without its closing ';', or a ValueError if it might do more than read.

    Spark's parser has to read the text as one statement that is no command. On
    top of that some words are refused wherever they stand, in literals and as
    function names too, and so are functions that call Java methods, in whatever way Spark's lexer would still
    read their name, and names that are put together from text (`IDENTIFIER(...)`).
    """
    session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    text = _without_end(sql)
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException as error:
        raise ValueError(f"not one statement that Spark can read: {error}") from error
    kind = plan.getClass().getSimpleName()
    command = session._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if command.isInstance(plan) or kind.endswith(("Command", "Statement", "Body")):
        raise ValueError(f"only queries run here, and this is a {kind}")
    words = _words(session, text)
    for word, following in zip(words, words[1:]):
        if following == "(" and word in (*JVM_FUNCTIONS, "identifier"):
            raise ValueError(f"a query here must not call {word!r}")
    return text


def _words(session: SparkSession, text: str) -> list[str]:
    """The text's tokens as Spark's own lexer reads them: no comments, names without backquotes and in lower case."""
    jvm = session._jvm
    parser = jvm.org.apache.spark.sql.catalyst.parser
    lexer = parser.SqlBaseLexer(parser.UpperCaseCharStream(jvm.org.antlr.v4.runtime.CharStreams.fromString(text)))
    return [t.getText().strip("`").lower() for t in lexer.getAllTokens() if t.getChannel() == 0]


def _without_end(sql: str) -> str:
    """The text without its closing ';', once the word lists let it pass."""
    text = sql.strip().removesuffix(";").rstrip()
    if not text or text.endswith(";"):
        raise ValueError("there is no query, or an empty one behind it")
    if found := _REFUSED.search(text):
        raise ValueError(f"a query here must not have the word {found[0]!r}")
    return text


def sql_query(
    spark: SparkSession,
    sql: str,
    params: Sequence[Any] | Mapping[str, Any] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run a read-only query. Parameters are `?` or `:name` markers.

    `tables` are there under their names for this query only; temporary views of the same names come back.
    """
    text = check_read_only(sql, spark)
    args = dict(params) if isinstance(params, Mapping) else list(params or [])
    catalog = spark._jsparkSession.sessionState().catalog()
    before = {n: spark.table(n) for n in tables or {} if catalog.getTempView(n).isDefined()}
    try:
        for name, table in (tables or {}).items():
            table.createOrReplaceTempView(name)
        return spark.sql(text, args=args or None)  # names are resolved here
    finally:
        for name in tables or {}:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    sql: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 0,
) -> DataFrame:
    """A read-only query on an external database; with bounds, read in parallel slices.

    The database's dialect is not Spark's, so the text is judged by its words: one SELECT or WITH.
    """
    text = _without_end(sql)
    if ";" in text or not re.match(r"(?:select|with)\b", text, re.IGNORECASE):
        raise ValueError("a database is asked by one SELECT or WITH query")
    reader = spark.read.format("jdbc").option("url", url).options(**dict(properties or {}))
    query = f"({text}) source_query"
    reader = reader.option("dbtable", query)
    if partition_column and bounds and partitions > 1:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1])).option("numPartitions", str(partitions))
        )
    return reader.load()


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, the way log and lake query services return results."""
    out = []
    for field in df.schema:
        c = col(field.name)
        text = F.decode(c, "UTF-8") if isinstance(field.dataType, T.BinaryType) else c.cast("string")
        out.append(text.alias(field.name))
    return df.select(*out)
