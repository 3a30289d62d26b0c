"""Run, health and audit logs; quotas; searches and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.catalogue.inputs import (
    AUDIT, EXECUTIONS, HEALTH, ROLES, SCHEDULES, USER_QUOTAS_SQL, VENDOR_ERRORS, derived, role_quota_table, table,
)
from tidewell.frame import Frame, col
from tidewell.functions import classify_code, classify_error, error_trip_kind, soft_limit_bucket, trip_kinds
from tidewell.operators import head, page, row_limit, sort_rows
from tidewell.operators.history import (
    due_rows, duration_buckets, kpi_delta, latest_state, multi_search, over_quota, recent_n, role_quotas, skip_buckets,
    status_counts, text_search, trailing_usage, trips_by_type,
)
from tidewell.operators.limits import matching
from tidewell.operators.quota import quota_admission
from tidewell.operators.textindex import text_search_indexed, write_text_index
from tidewell.session import scratch_dir

NOW = datetime(2024, 1, 20, 12, 0, 0)


def _latest_state(spark, d):
    checks = derived(spark, d, HEALTH).withColumn("error_code", classify_error(col("last_error")))
    return latest_state(
        checks, "connection_id", ["last_tested_at", "id"], ["status", "last_error", "error_code", "duration_s"]
    )


def _recent_n(spark, d):
    return recent_n(derived(spark, d, EXECUTIONS), "workflow_id", ["started_at", "id"], 7)


def _quotas(spark, d):
    return role_quotas(derived(spark, d, ROLES), role_quota_table(spark))


def _trailing_usage(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return trailing_usage(events, ["event_type", "user_id"], "ts")


def _over_quota(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return over_quota(trailing_usage(events, ["user_id"], "ts"), _quotas(spark, d)).select(
        "event_id", "user_id", "used", "quota", "over_quota"
    )


def _quota_admission(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return quota_admission(events, _quotas(spark, d)).withColumn("retry_after", F.round("retry_after", 3))


# The events pressed into three hours, a third of them by one user.
_BUSY = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 4 END AS user_id,
       {at} AS ts FROM events
"""
_BUSY_SPARK = _BUSY.format(at="CAST(timestamp_micros(1704067200000000 + CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 240) AS BIGINT)) AS TIMESTAMP_NTZ)")
_BUSY_DUCK = _BUSY.format(at="make_timestamp(1704067200000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 240) AS BIGINT))")
_BUSY_QUOTA = 300


def _quota_admission_hot(spark, d):
    """Few busy users with a quota of hundreds, who make no pause."""
    busy = derived(spark, d, _BUSY_SPARK)
    quotas = spark.createDataFrame([(u, _BUSY_QUOTA) for u in range(5)], "user_id long, quota long")
    decided = quota_admission(busy, quotas)
    return decided.select("event_id", "user_id", "allowed", "used").withColumn("user_id", F.col("user_id").cast("long"))


def _skip_buckets(spark, d):
    return skip_buckets(derived(spark, d, EXECUTIONS).where("status = 'skipped'"), "started_at", NOW)


def _trips_by_type(spark, d):
    return trips_by_type(derived(spark, d, AUDIT), datetime(2024, 1, 29))


def _status_counts(spark, d):
    return status_counts(
        derived(spark, d, EXECUTIONS),
        {"succeeded": "status = 'succeeded'", "failed": "status = 'failed'", "slow": "duration_s > 120"},
    )


def _kpi_delta(spark, d):
    return kpi_delta(
        derived(spark, d, EXECUTIONS), "started_at", datetime(2024, 1, 16), datetime(2024, 1, 9),
        datetime(2024, 1, 23), ["workflow_id"],
    )


def _duration_buckets(spark, d):
    return duration_buckets(derived(spark, d, EXECUTIONS), "duration_s", "status")


def _audit_filter(spark, d):
    return matching(
        derived(spark, d, AUDIT), {"resource_type": "error", "outcome": "failure", "actor_id": None}, "created_at",
        datetime(2024, 1, 5), datetime(2024, 1, 25),
    )


def _audit_page(spark, d):
    first = page(_audit_filter(spark, d), ["created_at", "id"], 20, offset=40)
    return first.withColumn("page", F.lit("offset")).unionAll(
        page(_audit_filter(spark, d), ["created_at", "id"], 500, before=[datetime(2024, 1, 15), 0], maximum=500).withColumn(
            "page", F.lit("before")
        )
    ).unionAll(_page_over_nulls(spark, d))


def _page_over_nulls(spark, d):
    """A page that goes on from dated rows to undated ones, and one that starts among these."""
    partly = derived(spark, d, AUDIT).withColumn("created_at", F.when(F.col("id") % 7 != 0, F.col("created_at")))
    dated = page(partly, ["created_at", "id"], 150, before=[datetime(2024, 1, 1, 1), 0]).withColumn("page", F.lit("to nulls"))
    return dated.unionAll(page(partly, ["created_at", "id"], 30, before=[None, 500]).withColumn("page", F.lit("in nulls")))


def _audit_total(spark, d):
    return _audit_filter(spark, d).agg(F.count(F.lit(1)).alias("total"))


def _text_search(spark, d):
    return text_search(
        table(spark, d, "documents"), "  OneDou ", ["text", "source"], {"lang": "EN"}, {"source": "src3"}
    ).orderBy(F.lower("source"), "doc_id").select("doc_id", "lang", "source")


def _text_search_indexed(spark, d):
    """The same search over an index of trigrams, another needle, and one too short for the index."""
    documents, path = table(spark, d, "documents"), scratch_dir(spark, "grams") + "/documents"
    write_text_index(documents, path, "doc_id", ["text", "source"])
    out = None
    for needle, lang in (("  OneDou ", "EN"), ("idiot", ""), ("ß", "")):
        found = text_search_indexed(spark, documents, path, needle, "doc_id", ["text", "source"], equal_fold={"lang": lang})
        found = found.select(F.lit(needle.strip()).alias("needle"), "doc_id", "lang", "source")
        out = found if out is None else out.unionAll(found)
    return out


def _multi_search(spark, d):
    return multi_search(
        {
            "customer": (table(spark, d, "customer"), "c_custkey", "c_name"),
            "supplier": (table(spark, d, "supplier"), "s_suppkey", "s_name"),
            "nation": (table(spark, d, "nation"), "n_nationkey", "n_name"),
            "region": (table(spark, d, "region"), "r_regionkey", "r_name"),
        },
        "ION",
    )


def _due_rows(spark, d):
    return due_rows(derived(spark, d, SCHEDULES), datetime(2024, 1, 30, 12, 0))


def _row_limit(spark, d):
    frame = row_limit(Frame(table(spark, d, "lineitem")), 0, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return frame.df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(frame.meta.truncated).alias("truncated"))


def _limit_ordered(spark, d):
    return head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, [F.desc("o_totalprice"), "o_orderkey"])


def _sort_topk(spark, d):
    high = sort_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "desc").limit(15)
    low = sort_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "asc").limit(15)
    return high.unionAll(low)


def _classify_error(spark, d):
    return derived(spark, d, HEALTH).select("id", classify_error(col("last_error")).alias("code"))


def _classify_code(spark, d):
    return derived(spark, d, VENDOR_ERRORS).select("id", classify_code(col("vendor"), col("code")).alias("kind"))


def _trip_kind(spark, d):
    events = table(spark, d, "events")
    warnings = F.expr(
        "array(CASE WHEN value > 100 THEN 'Column cap reached at 512 columns.' END, "
        "CASE WHEN value < 20 THEN '3 cell(s) exceeded per-type cell limits and were truncated' END, "
        "CASE WHEN event_type = 'view' THEN 'Row count is 90, at least 80% of the 100 row cap.' END, "
        "CASE WHEN event_type = 'click' THEN 'Response body is 9 bytes' ELSE 'something else' END)"
    )
    error = F.expr(
        "CASE event_type WHEN 'view' THEN 'json exceeds the Maximum Depth of 64' WHEN 'click' THEN 'token limit' "
        "WHEN 'error' THEN 'Rate limit hit' WHEN 'signup' THEN 'memory pressure' ELSE 'other' END"
    )
    return events.select(
        "event_id", F.array_join(trip_kinds(warnings), ",").alias("warning_kinds"), error_trip_kind(error).alias("error_kind")
    )


def _soft_bucket(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("event_type", soft_limit_bucket(F.lit(0.8) + F.col("value") / 1000).alias("ratio")).agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    "latest_state": _latest_state,
    "recent_n": _recent_n,
    "role_quota": _quotas,
    "trailing_usage": _trailing_usage,
    "over_quota": _over_quota,
    "quota_admission": _quota_admission,
    "quota_admission_hot": _quota_admission_hot,
    "skip_buckets": _skip_buckets,
    "trips_by_type": _trips_by_type,
    "status_counts": _status_counts,
    "kpi_delta": _kpi_delta,
    "duration_buckets": _duration_buckets,
    "audit_page": _audit_page,
    "audit_total": _audit_total,
    "text_search": _text_search,
    "text_search_indexed": _text_search_indexed,
    "multi_search": _multi_search,
    "due_rows": _due_rows,
    "row_limit": _row_limit,
    "limit_ordered": _limit_ordered,
    "sort_topk": _sort_topk,
    "classify_error": _classify_error,
    "classify_code": _classify_code,
    "trip_kind": _trip_kind,
    "soft_bucket": _soft_bucket,
}

_PARTLY = f"SELECT * REPLACE (CASE WHEN id % 7 <> 0 THEN created_at END AS created_at) FROM ({AUDIT})"
_CODE = """CASE WHEN last_error IS NULL THEN NULL
    WHEN regexp_matches(lower(last_error), 'password authentication failed|authentication failed|invalid_grant|invalid api key|unauthorized| 401') THEN 'auth_failed'
    WHEN regexp_matches(lower(last_error), 'access denied|forbidden|permission denied| 403') THEN 'permission_denied'
    WHEN regexp_matches(lower(last_error), 'no such host|connection refused|network is unreachable|no route to host') THEN 'network_unreachable'
    WHEN regexp_matches(lower(last_error), 'context deadline exceeded|i/o timeout|timed out') THEN 'timeout'
    WHEN regexp_matches(lower(last_error), 'does not exist|not found| 404') THEN 'not_found'
    WHEN regexp_matches(lower(last_error), 'rate limit|too many requests|throttl| 429') THEN 'rate_limited'
    WHEN regexp_matches(lower(last_error), 'is required|must be a valid|invalid config|configure authentication') THEN 'invalid_config'
    ELSE 'unknown' END"""

_AUDIT_WHERE = """resource_type = 'error' AND outcome = 'failure'
    AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'"""

# The allowed hits of each user, by folding over the user's hits in time order:
# a hit is taken if fewer than `quota` taken ones lie within the hour before it.
_ALLOWED = f"""
    SELECT user_id, quota, list_reduce(
        list([epoch_us(ts)] ORDER BY ts, event_id),
        lambda taken, hit: CASE
            WHEN len(list_filter(taken, lambda t: t > hit[1] - 3600000000)) < any_quota THEN list_concat(taken, hit)
            ELSE taken END,
        CAST([] AS BIGINT[])) AS taken
    FROM (SELECT e.user_id, e.ts, e.event_id, q.quota, q.quota AS any_quota FROM events e JOIN ({USER_QUOTAS_SQL}) q
          ON e.user_id = q.user_id)
    GROUP BY user_id, quota, any_quota"""

ORACLE = {
    "latest_state": f"""
        SELECT connection_id, status, last_error, {_CODE} AS error_code, duration_s FROM (
            SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY last_tested_at DESC, id DESC) AS rn
            FROM ({HEALTH})) WHERE rn = 1""",
    "recent_n": f"""
        SELECT id, workflow_id, status, started_at, duration_s, CAST(rn AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY started_at DESC, id DESC) AS rn
            FROM ({EXECUTIONS})) WHERE rn <= 7""",
    "role_quota": USER_QUOTAS_SQL,
    "trailing_usage": """
        SELECT event_id, user_id, event_type, ts, count(*) OVER (
            PARTITION BY user_id, event_type ORDER BY ts
            RANGE BETWEEN INTERVAL '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS used FROM events""",
    "over_quota": f"""
        SELECT event_id, user_id, used, quota, quota > 0 AND used > quota AS over_quota FROM (
            SELECT event_id, user_id, count(*) OVER (
                PARTITION BY user_id ORDER BY ts
                RANGE BETWEEN INTERVAL '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS used FROM events)
        JOIN ({USER_QUOTAS_SQL}) q USING (user_id)""",
    "quota_admission": f"""
        SELECT event_id, user_id, ts, list_contains(taken, us) AS allowed, len(live) AS used, quota,
               CASE WHEN NOT list_contains(taken, us)
                    THEN round(greatest((live[1] + 3600000000 - us) / 1000000, 1.0), 3) END AS retry_after
        FROM (SELECT e.event_id, e.user_id, e.ts, epoch_us(e.ts) AS us, a.quota, a.taken,
                     list_filter(a.taken, lambda t: t > epoch_us(e.ts) - 3600000000 AND t <= epoch_us(e.ts)) AS live
              FROM events e JOIN ({_ALLOWED}) a ON e.user_id = a.user_id)""",
    "quota_admission_hot": f"""
        WITH busy AS ({_BUSY_DUCK}),
        folded AS (
            SELECT user_id, list_reduce(
                list([epoch_us(ts)] ORDER BY ts, event_id),
                lambda taken, hit: CASE
                    WHEN len(list_filter(taken, lambda t: t > hit[1] - 3600000000)) < {_BUSY_QUOTA} THEN list_concat(taken, hit)
                    ELSE taken END,
                CAST([] AS BIGINT[])) AS taken
            FROM busy GROUP BY user_id)
        SELECT b.event_id, CAST(b.user_id AS BIGINT) AS user_id, list_contains(taken, epoch_us(b.ts)) AS allowed,
               len(list_filter(taken, lambda t: t > epoch_us(b.ts) - 3600000000 AND t <= epoch_us(b.ts))) AS used
        FROM busy b JOIN folded f ON b.user_id = f.user_id""",
    "skip_buckets": f"""
        SELECT CAST(i AS INTEGER) AS slot, TIMESTAMP '2024-01-19 12:00:00' + i * INTERVAL 2 HOUR AS start, count(e.id) AS n
        FROM range(0, 12) t(i) LEFT JOIN (SELECT * FROM ({EXECUTIONS}) WHERE status = 'skipped') e
          ON e.started_at >= TIMESTAMP '2024-01-19 12:00:00' + i * INTERVAL 2 HOUR
         AND e.started_at < TIMESTAMP '2024-01-19 14:00:00' + i * INTERVAL 2 HOUR GROUP BY i""",
    "trips_by_type": f"""
        SELECT split_part(action, '.', 3) AS limit_type, count(*) AS n FROM ({AUDIT})
        WHERE action LIKE 'guardrail.trip.%' AND created_at >= TIMESTAMP '2024-01-29' GROUP BY 1""",
    "status_counts": f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE status = 'succeeded') AS succeeded,
               count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE duration_s > 120) AS slow
        FROM ({EXECUTIONS})""",
    "kpi_delta": f"""
        SELECT workflow_id, now AS current, prev AS previous, CAST(pct AS BIGINT) AS pct,
               CASE WHEN now > prev THEN 'up' WHEN now < prev THEN 'down' ELSE 'flat' END AS direction,
               CASE WHEN now > prev THEN '+' WHEN now < prev THEN '−' ELSE '' END || CAST(abs(pct) AS BIGINT) || '%' AS label
        FROM (SELECT *, CASE WHEN prev = 0 THEN 100 ELSE floor((now - prev) / prev * 100 + 0.5) END AS pct FROM (
            SELECT workflow_id, count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-16') AS now,
                   count(*) FILTER (WHERE started_at < TIMESTAMP '2024-01-16') AS prev FROM ({EXECUTIONS})
            WHERE started_at >= TIMESTAMP '2024-01-09' AND started_at < TIMESTAMP '2024-01-23' GROUP BY 1))""",
    "duration_buckets": f"""
        SELECT status AS outcome, b AS le, count(*) FILTER (WHERE b IS NULL OR duration_s <= b) AS n
        FROM ({EXECUTIONS}),
             (SELECT unnest([0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, NULL]::DOUBLE[]) AS b)
        GROUP BY 1, 2""",
    "audit_page": f"""
        SELECT *, 'offset' AS page FROM (SELECT * FROM ({AUDIT}) WHERE {_AUDIT_WHERE}
            ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40)
        UNION ALL
        SELECT *, 'before' AS page FROM (SELECT * FROM ({AUDIT}) WHERE {_AUDIT_WHERE}
            AND created_at < TIMESTAMP '2024-01-15' ORDER BY created_at DESC, id DESC LIMIT 500)
        UNION ALL
        SELECT *, 'to nulls' AS page FROM (SELECT * FROM ({_PARTLY})
            WHERE created_at < TIMESTAMP '2024-01-01 01:00:00' OR created_at IS NULL
            ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 150)
        UNION ALL
        SELECT *, 'in nulls' AS page FROM (SELECT * FROM ({_PARTLY}) WHERE created_at IS NULL AND id < 500 ORDER BY id DESC LIMIT 30)""",
    "audit_total": f"SELECT count(*) AS total FROM ({AUDIT}) WHERE {_AUDIT_WHERE}",
    "text_search": """
        SELECT doc_id, lang, source FROM documents
        WHERE (contains(lower(text), 'onedou') OR contains(lower(source), 'onedou')) AND lower(lang) = 'en' AND source = 'src3'""",
    "text_search_indexed": " UNION ALL ".join(
        f"""
        SELECT '{needle}' AS needle, doc_id, lang, source FROM documents
        WHERE (contains(lower(text), '{needle.lower()}') OR contains(lower(source), '{needle.lower()}')) AND ('{lang}' = '' OR lower(lang) = '{lang}')"""
        for needle, lang in (("OneDou", "en"), ("idiot", ""), ("ß", ""))
    ),
    "multi_search": """
        SELECT type, id, name FROM (
            SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer
            WHERE contains(lower(c_name), 'ion')
            UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'ion')
            UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation
            UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region)
        ORDER BY name, type, id LIMIT 10""",
    "due_rows": f"""
        SELECT * FROM ({SCHEDULES}) WHERE schedule_enabled AND schedule_next_run <= TIMESTAMP '2024-01-30 12:00:00'""",
    "row_limit": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRUE AS truncated FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000""",
    "limit_ordered": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_topk": """
        SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 15)
        UNION ALL SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 15)""",
    "classify_error": f"SELECT id, {_CODE} AS code FROM ({HEALTH})",
    "classify_code": f"""
        SELECT id, CASE
            WHEN vendor = 'postgres' AND code IN ('28P01', '28000') THEN 'auth_failed'
            WHEN vendor = 'postgres' AND code = '3D000' THEN 'not_found'
            WHEN vendor = 'postgres' AND code = '42501' THEN 'permission_denied'
            WHEN vendor = 'mysql' AND code = '1045' THEN 'auth_failed'
            WHEN vendor = 'mysql' AND code = '1049' THEN 'not_found'
            WHEN vendor = 'mysql' AND code IN ('1044', '1142') THEN 'permission_denied'
            WHEN vendor = 'AWS' AND code = 'AccessDenied' THEN 'permission_denied'
            WHEN vendor = 'AWS' AND code = 'ExpiredToken' THEN 'auth_failed'
            WHEN vendor = 'AWS' AND code = 'NoSuchBucket' THEN 'not_found'
            WHEN vendor = 'AWS' AND code = 'ThrottlingException' THEN 'rate_limited'
            WHEN vendor = 'http' AND code = '401' THEN 'auth_failed'
            WHEN vendor = 'http' AND code = '403' THEN 'permission_denied'
            WHEN vendor = 'http' AND code = '404' THEN 'not_found'
            WHEN vendor = 'http' AND code = '429' THEN 'rate_limited'
            ELSE 'unknown' END AS kind FROM ({VENDOR_ERRORS})""",
    "trip_kind": """
        SELECT event_id, concat_ws(',', CASE WHEN value < 20 THEN 'cell_bytes' END,
                   CASE WHEN event_type = 'click' THEN 'http_response_body_bytes' END,
                   CASE WHEN value > 100 THEN 'max_columns' END, CASE WHEN event_type = 'view' THEN 'max_rows' END)
               AS warning_kinds,
               CASE event_type WHEN 'view' THEN 'json_depth' WHEN 'click' THEN 'json_elements' WHEN 'error' THEN 'quota'
                    WHEN 'signup' THEN 'memory_pressure' END AS error_kind FROM events""",
    "soft_bucket": """
        SELECT event_type, CASE WHEN 0.8::DOUBLE + value / 1000 >= 0.95 THEN '0.95' WHEN 0.8::DOUBLE + value / 1000 >= 0.9 THEN '0.90'
               ELSE '0.80' END AS ratio, count(*) AS n FROM events GROUP BY 1, 2""",
}
