"""Run queries on Spark and their checking SQL on DuckDB and compare the results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, (int, float, Decimal)):
        return repr(float(value))
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return [c[0] for c in result.description], result


# The Spark type each DuckDB type should meet.
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "HUGEINT": "bigint", "NULL": "string",
}


def type_notes(df, result):
    """Columns whose types differ between the engines (values may still agree)."""
    mine = dict(df.dtypes)
    theirs = {c[0]: str(c[1]) for c in result.description}
    return [f"{n}: {mine[n]} / {t}" for n, t in theirs.items() if mine.get(n) != TYPES.get(t, t.lower())]


def compare(spark, con, sf_dir, run, sql):
    """Problem text, or '' if both sides agree."""
    df = run(spark, sf_dir)
    mine = spark_rows(df)
    if sql is None:
        return "" if mine else "no rows"
    names, result = duck_rows(con, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = rows_of(names, result.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    notes = type_notes(df, result)
    if notes and mine == theirs:
        print("     types", notes)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main():
    from tidewell.catalogue import ORACLE, QUERIES
    from tidewell.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, sf_dir, run, ORACLE.get(name))
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {'' if name in ORACLE else '(rows only)'} {problem[:900]}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
