"""Analytics over run, health-check and audit logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.frame import col, dtype_of, literal_like, require
from tidewell.operators.limits import MAX_PAGE_SIZE, page_size

# Bounds of run durations in seconds, and the prefix of limit trips.
DURATION_BOUNDS = (0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0)
TRIP_PREFIX = "guardrail.trip."


def latest_state(df: DataFrame, entity: str, order: Sequence[str], state: Sequence[str]) -> DataFrame:
    """The state columns of each entity's newest row.

    `order` decides what is newest and must end in a unique column. The first order column's maximum is found
    first: a hash aggregate over two narrow columns, with one row per entity and task in the shuffle. Only the
    rows at it are compared by the other columns, so no task sorts the log. Streams are read once and keep one
    row per entity as state. Null moments are the oldest.
    """
    require(df, entity, *order, *state)
    rows = df
    if not df.isStreaming and len(order) > 1:
        most = df.groupBy(col(entity).alias("__entity")).agg(F.max(col(order[0])).alias("__most"))
        same = col(entity).eqNullSafe(F.col("__entity")) & col(order[0]).eqNullSafe(F.col("__most"))
        rows = df.join(most, same, "left_semi")
    newest = F.max_by(
        F.struct(*[col(c) for c in state]), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])
    )
    return rows.groupBy(col(entity)).agg(newest.alias("__state")).select(
        col(entity), *[F.col("__state").getField(c).alias(c) for c in state]
    )


def recent_n(
    df: DataFrame, entity: str, order: Sequence[str], n: int | None = None, maximum: int = MAX_PAGE_SIZE
) -> DataFrame:
    """Each entity's newest n rows (default 50, at most `maximum`), numbered in `rank`.

    The rank filter is also applied before the shuffle (window group limit), so
    a busy entity sends at most n rows per task.
    """
    require(df, entity, *order)
    newest = Window.partitionBy(col(entity)).orderBy(*[col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= page_size(n, maximum))


def role_quotas(user_roles: DataFrame, quotas: DataFrame, user: str = "user_id", role: str = "role") -> DataFrame:
    """`user, quota` per user: the largest quota of the user's roles."""
    return (
        user_roles.join(quotas.withColumnRenamed(role, "__role"), col(role) == F.col("__role"), "left")
        .groupBy(col(user)).agg(F.coalesce(F.max("quota"), F.lit(0)).alias("quota"))
    )


# Slices of a bucket of trailing usage.
SLICES = 60


def trailing_usage(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window: timedelta = timedelta(hours=1),
    bucket: timedelta = timedelta(minutes=1),
) -> DataFrame:
    """Adds `used`: rows of the same key within (ts - window, ts], peers included.

    Each row counts +1 when it comes and -1 when it leaves the window, and
    `used` is the running sum. The sum is taken in three steps, within short slices of time, over the totals of a bucket's
    slices, and over the totals of buckets: the rows of one busy key are spread over its slices, those of one busy bucket too,
    instead of being sorted in one task. Each level starts with what the level above it carries over, as one more row.
    """
    require(df, *keys, ts)
    seconds = window.total_seconds()
    slice_ = max(1, bucket // timedelta(microseconds=SLICES))
    length = F.expr(f"INTERVAL '{seconds:.6f}' SECOND")
    payload = [c for c in df.columns if c not in keys]
    steps = F.array(
        F.struct(col(ts).alias("at"), F.lit(1).alias("delta")),
        F.struct((col(ts) + length).alias("at"), F.lit(-1).alias("delta")),
    )
    moves = df.select(
        *[col(k) for k in keys], F.struct(*[col(c) for c in payload]).alias("__row"), F.inline(steps)
    ).select(
        *[col(k) for k in keys], "at", F.col("delta").cast("long").alias("delta"),
        F.when(F.col("delta") > 0, F.col("__row")).alias("__row"),
        F.floor(F.unix_micros(F.col("at").cast("timestamp")) / F.lit(slice_)).cast("long").alias("__slice"),
    )
    by_key = [col(k) for k in keys]
    bucket_no = F.floor(F.col("__slice") / F.lit(SLICES)).cast("long").alias("__bucket")
    slices = moves.groupBy(*by_key, "__slice").agg(F.sum("delta").alias("__total"))
    slices = slices.select(*by_key, bucket_no, "__slice", "__total")
    earlier = Window.partitionBy(*by_key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.groupBy(*by_key, "__bucket").agg(F.sum("__total").alias("__total")).select(
        *by_key, "__bucket", F.lit(None).cast("long").alias("__slice"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__total")
    )
    inside = Window.partitionBy(*by_key, "__bucket").orderBy(F.col("__slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.unionAll(starts).withColumn("__carry", F.sum("__total").over(inside)).where("__slice IS NOT NULL").select(
        *by_key, F.lit(None).cast(dtype_of(moves, "at")).alias("at"), F.col("__carry").alias("delta"),
        F.lit(None).cast(dtype_of(moves, "__row")).alias("__row"), "__slice",
    )
    within = (
        Window.partitionBy(*by_key, "__slice").orderBy(F.col("at").asc_nulls_first())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = moves.unionAll(carried).withColumn("used", F.sum("delta").over(within)).where("__row IS NOT NULL")
    columns = [(col(c) if c in keys else F.col("__row").getField(c)).alias(c) for c in df.columns]
    return counted.select(*columns, "used")


def over_quota(
    usage: DataFrame, quotas: DataFrame, user: str = "user_id", quota: str = "quota"
) -> DataFrame:
    """Adds `quota` and `over_quota` to `trailing_usage`; no quota or <= 0 is unlimited."""
    limits = quotas.select(col(user).alias("__user"), col(quota).alias("__quota"))
    limit = F.coalesce(F.col("__quota"), F.lit(0))
    return usage.join(limits, col(user) == F.col("__user"), "left").select(
        *[col(c) for c in usage.columns], limit.alias("quota"),
        ((limit > 0) & (F.col("used") > limit)).alias("over_quota"),
    )


def skip_buckets(
    df: DataFrame,
    ts: str,
    now: datetime,
    keys: Sequence[str] = (),
    buckets: int = 12,
    width: timedelta = timedelta(hours=2),
) -> DataFrame:
    """Row counts of the last `buckets` time slices before `now`, zero-filled.

    Per key (or overall) one row per slice: `slot` from 0 (oldest), `start`, `n`.
    """
    require(df, ts, *keys)
    starts = [literal_like(df, ts, now - width * (buckets - i)) for i in range(buckets + 1)]
    recent = df.where((col(ts) >= starts[0]) & (col(ts) < starts[-1]))
    counts = [
        F.count_if((col(ts) >= starts[i]) & (col(ts) < starts[i + 1])).alias(f"n{i}") for i in range(buckets)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), starts[i].alias("start"), F.col(f"n{i}").alias("n"))
            for i in range(buckets)
        ]
    )
    grouped = recent.groupBy(*[col(k) for k in keys]).agg(*counts)
    return grouped.select(*[col(k) for k in keys], F.inline(rows))


def trips_by_type(audit: DataFrame, since: Any, action: str = "action", ts: str = "created_at") -> DataFrame:
    """`limit_type, n`: limit trips in an audit log since a moment, sorted."""
    hits = audit.where(col(action).startswith(TRIP_PREFIX) & (col(ts) >= literal_like(audit, ts, since)))
    return (
        hits.groupBy(F.split_part(col(action), F.lit("."), F.lit(3)).alias("limit_type"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy("limit_type")
    )


def status_counts(df: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """One row: how many rows meet each named SQL condition, and `total`."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(e)).alias(n) for n, e in conditions.items()]
    )


def kpi_delta(
    df: DataFrame, ts: str, split: Any, start: Any, end: Any, keys: Sequence[str] = (), value: str | None = None
) -> DataFrame:
    """Current period [split, end) against the previous one [start, split).

    Row counts, or sums of `value`. `pct` is 100 when the previous period is 0
    and null when both are; `direction` is up, down or flat.
    """
    require(df, ts, *keys)
    begin, middle, stop = (literal_like(df, ts, m) for m in (start, split, end))
    amount = col(value).cast("double") if value else F.lit(1).cast("long")
    zero = F.lit(0.0) if value else F.lit(0).cast("long")
    used = df.where((col(ts) >= begin) & (col(ts) < stop))
    out = used.groupBy(*[col(k) for k in keys]).agg(
        F.coalesce(F.sum(F.when(col(ts) >= middle, amount)), zero).alias("current"),
        F.coalesce(F.sum(F.when(col(ts) < middle, amount)), zero).alias("previous"),
    )
    return with_delta(out, "current", "previous")


def with_delta(df: DataFrame, current: str, previous: str) -> DataFrame:
    """Adds `pct`, `direction` and `label` comparing two numbers."""
    now, then = col(current), col(previous)
    difference = now - then
    none = (now == 0) & (then == 0)
    # Halves round up, also below zero.
    share = F.when(then == 0, 100).otherwise(F.floor(difference / F.nullif(then, F.lit(0)) * 100 + 0.5).cast("long"))
    direction = F.when(difference > 0, "up").when(difference < 0, "down").otherwise("flat")
    sign = F.when(difference > 0, "+").when(difference < 0, "−").otherwise("")
    return df.withColumns(
        {
            "pct": F.when(~none, share).cast("long"),
            "direction": F.when(~none, direction),
            "label": F.when(~none, F.concat(sign, F.abs(share).cast("string"), F.lit("%"))),
        }
    )


def duration_buckets(
    df: DataFrame, seconds: str, outcome: str, bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    """Cumulative duration histogram by outcome: `outcome, le, n`, `le` null for all."""
    require(df, seconds, outcome)
    counts = [F.count_if(col(seconds) <= b).alias(f"n{i}") for i, b in enumerate(bounds)]
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("all_rows").alias("n")))
    return df.groupBy(col(outcome).alias("outcome")).agg(*counts, F.count(F.lit(1)).alias("all_rows")).select(
        "outcome", F.inline(F.array(*rows))
    )


def text_search(
    df: DataFrame,
    query: str = "",
    text: Sequence[str] = ("name", "description"),
    equal_fold: Mapping[str, str] | None = None,
    exact: Mapping[str, str] | None = None,
) -> DataFrame:
    """Case-insensitive substring search; the caller orders the result."""
    require(df, *text, *(equal_fold or {}), *(exact or {}))
    out = df
    needle = query.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in text:
            hit = hit | F.contains(F.lower(col(name)), F.lit(needle))
        out = out.where(hit)
    for name, wanted in (equal_fold or {}).items():
        if wanted and wanted.strip():
            out = out.where(F.lower(col(name)) == wanted.strip().lower())
    for name, wanted in (exact or {}).items():
        if wanted and wanted.strip():
            out = out.where(col(name) == wanted.strip())
    return out


def multi_search(kinds: Mapping[str, tuple[DataFrame, str, str]], query: str = "", limit: int = 10) -> DataFrame:
    """Search several tables at once: `type, id, name`, the first by name.

    `kinds` maps a type name to (table, id column, name column). A row matches by
    its name or its type; each table keeps its own first rows before the union.
    """
    needle = query.strip().lower()
    out: DataFrame | None = None
    for kind, (table, id_column, name_column) in kinds.items():
        rows = table.select(
            F.lit(kind).alias("type"), col(id_column).cast("string").alias("id"), col(name_column).alias("name")
        )
        if needle and needle not in kind.lower():
            rows = rows.where(F.contains(F.lower("name"), F.lit(needle)))
        first = rows.orderBy("name", "type", "id").limit(limit)
        out = first if out is None else out.unionAll(first)
    if out is None:
        raise ValueError("nothing to search")
    return out.orderBy("name", "type", "id").limit(limit)


def due_rows(df: DataFrame, now: Any, enabled: str = "schedule_enabled", next_run: str = "schedule_next_run") -> DataFrame:
    """Enabled rows whose next run is at or before `now`."""
    return df.where(col(enabled) & (col(next_run) <= literal_like(df, next_run, now)))
