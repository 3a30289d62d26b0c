"""Input tables of the registered queries.

Log-shaped tables are derived from `events` with SQL that Spark and the checking
engine both read, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A table derived from given tables by SQL."""
    for name in names or ("events",):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


AUDIT = """
SELECT event_id AS id, user_id AS actor_id,
       CASE WHEN event_type <> 'error' THEN concat('connections.', event_type)
            WHEN value < 10 THEN 'guardrail.trip.max_rows'
            WHEN value < 40 THEN 'guardrail.trip.cell_bytes'
            WHEN value < 90 THEN 'guardrail.trip.json_depth'
            ELSE 'guardrail.trip.quota' END AS action,
       event_type AS resource_type,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
       ts AS created_at
FROM events
"""

EXECUTIONS = """
SELECT event_id AS id, user_id AS workflow_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'succeeded' END AS status,
       ts AS started_at, value AS duration_s
FROM events
"""

HEALTH = """
SELECT event_id AS id, user_id AS connection_id,
       CASE WHEN event_type = 'error' THEN 'unhealthy' ELSE 'healthy' END AS status,
       CASE WHEN event_type <> 'error' THEN NULL
            WHEN value < 10 THEN concat('password authentication failed for user ', CAST(user_id AS VARCHAR(20)))
            WHEN value < 20 THEN 'HTTP 403 Forbidden'
            WHEN value < 35 THEN 'dial tcp: No such host'
            WHEN value < 50 THEN 'context deadline exceeded while waiting'
            WHEN value < 65 THEN concat('relation "t', CAST(user_id AS VARCHAR(20)), '" does not exist')
            WHEN value < 80 THEN '429 Too Many Requests'
            WHEN value < 95 THEN 'endpoint is required'
            ELSE concat('something unexpected: ', props) END AS last_error,
       value AS duration_s, ts AS last_tested_at
FROM events
"""

VENDOR_ERRORS = """
SELECT event_id AS id,
       CASE event_type WHEN 'error' THEN 'postgres' WHEN 'view' THEN 'mysql' WHEN 'click' THEN 'AWS'
            WHEN 'signup' THEN 'http' ELSE 'oracle' END AS vendor,
       CASE event_type
            WHEN 'error' THEN CASE WHEN value < 20 THEN '28P01' WHEN value < 40 THEN '3D000'
                                   WHEN value < 60 THEN '42501' ELSE 'XX000' END
            WHEN 'view' THEN CASE WHEN value < 20 THEN '1045' WHEN value < 40 THEN '1049'
                                  WHEN value < 60 THEN '1142' ELSE '9999' END
            WHEN 'click' THEN CASE WHEN value < 20 THEN 'AccessDenied' WHEN value < 40 THEN 'ExpiredToken'
                                   WHEN value < 60 THEN 'NoSuchBucket' WHEN value < 80 THEN 'ThrottlingException'
                                   ELSE 'SomethingElse' END
            WHEN 'signup' THEN CASE WHEN value < 20 THEN '401' WHEN value < 40 THEN '403'
                                    WHEN value < 60 THEN '404' WHEN value < 80 THEN '429' ELSE '500' END
            ELSE '401' END AS code
FROM events
"""

SCHEDULES = """
SELECT user_id AS id, max(event_type) <> 'view' AS schedule_enabled, max(ts) AS schedule_next_run
FROM events GROUP BY user_id
"""

# Quotas by role, and the roles of each user: users have one or two roles.
ROLES = """
SELECT user_id, 'viewer' AS role FROM events GROUP BY user_id
UNION ALL
SELECT user_id, 'editor' AS role FROM events GROUP BY user_id HAVING max(value) > 150
UNION ALL
SELECT user_id, 'admin' AS role FROM events GROUP BY user_id HAVING max(value) > 300
"""

ROLE_QUOTAS = {"viewer": 1, "editor": 2}

USER_QUOTAS_SQL = f"""
SELECT user_id, CAST(max(CASE role WHEN 'viewer' THEN 1 WHEN 'editor' THEN 2 ELSE 0 END) AS BIGINT) AS quota
FROM ({ROLES}) r GROUP BY user_id
"""

QUERY_LOG = """
SELECT event_id AS id,
       CASE event_type
            WHEN 'error' THEN concat('SELECT *  FROM t WHERE k = ', props, ' ; ')
            WHEN 'view' THEN concat('  SELECT * FROM t /* by ', event_type, ' */ WHERE k = ', props)
            WHEN 'click' THEN concat('SELECT * FROM t -- note', chr(10), 'WHERE k = ', props, ';')
            WHEN 'signup' THEN concat('SELECT ''-- kept'' FROM t', chr(10), chr(9), 'WHERE k = ', props)
            ELSE concat('SELECT * FROM t WHERE k = ', props) END AS query
FROM events
"""


def role_quota_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLE_QUOTAS.items()), "role string, quota long")
