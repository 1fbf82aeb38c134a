"""Usage per key, tenant and user. Facts are aggregated before they meet the small dimension tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloquent.tables import once

LOG_COLUMNS = ("api_key_id", "endpoint", "deep_analysis", "use_audio", "processing_time_ms", "audio_duration_ms", "created_at", "tenant_id", "user_id")
BY_KEY = ("pronunciation", "scripted", "unscripted")
BY_TENANT = ("transcribe", "scripted", "pronunciation", "unscripted")


def logs_once(logs: DataFrame, columns: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    return once(logs, "id", *columns)


def _of(endpoints: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col("endpoint") == e).alias(f"{e}_requests") for e in endpoints]


def _per_key(logs: DataFrame) -> DataFrame:
    """One row per key that has logs; the hot key shrinks to a row per task before the shuffle."""
    return logs.groupBy("api_key_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("created_at")).alias("active_days"), F.avg("processing_time_ms").alias("avg_processing_time"), *_of(BY_KEY),
        F.count_if("deep_analysis").alias("deep_analysis_requests"), F.count_if("use_audio").alias("audio_requests"), F.max("created_at").alias("last_request_at"), F.min("created_at").alias("first_request_at"),
    )


_COUNTED = ("active_days", "pronunciation_requests", "scripted_requests", "unscripted_requests", "deep_analysis_requests", "audio_requests")


def _joined(keys: DataFrame, logs: DataFrame) -> DataFrame:
    active = keys.filter("is_active").select(F.col("id").alias("api_key_id"), F.col("description").alias("api_key_description"))
    x = active.join(_per_key(logs_once(logs)), "api_key_id", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(0)) for c in _COUNTED})


def usage_by_key(keys: DataFrame, logs: DataFrame) -> DataFrame:
    """Active keys with their usage. A key without logs counts 1 request: the row of the outer join is counted."""
    x = _joined(keys, logs)
    return x.select("api_key_id", "api_key_description", F.coalesce("n", F.lit(1)).alias("total_requests"), *_COUNTED, "avg_processing_time", "last_request_at", "first_request_at")


def usage_by_key_tenant(keys: DataFrame, bridge: DataFrame, tenants: DataFrame, logs: DataFrame) -> DataFrame:
    """As ``usage_by_key`` per tenant of the key (none: nulls; two: two rows), and a key without logs counts 0."""
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("subdomain").alias("tenant_subdomain"), F.col("display_name").alias("tenant_display_name"))
    x = _joined(keys, logs).join(bridge.select("api_key_id", "tenant_id").distinct(), "api_key_id", "left").join(t, "tenant_id", "left")
    return x.select(
        "api_key_id", "api_key_description", "tenant_id", "tenant_subdomain", "tenant_display_name", F.coalesce("n", F.lit(0)).alias("total_requests"),
        *_COUNTED, "avg_processing_time", "last_request_at", "first_request_at",
    )


def _partials(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and sums of logs by the given columns, endpoint and day: what tenants' figures are made of.

    A key or tenant with any share of the logs shrinks here, in each task before the shuffle and spread over users,
    endpoints and days in it, before it meets a dimension table.
    """
    return rows.groupBy(*by, "endpoint", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("processing_time_ms").alias("time"), F.count("processing_time_ms").alias("timed"), F.sum(F.col("audio_duration_ms").cast("bigint")).alias("audio"),
        F.max("created_at").alias("last"), F.min("created_at").alias("first"),
    )


def _activity() -> list[Column]:
    """The figures of ``_partials`` added up."""
    asked = [F.coalesce(F.sum(F.when(F.col("endpoint") == e, F.col("n"))), F.lit(0)).alias(f"{e}_requests") for e in BY_TENANT]
    return asked + [
        (F.sum("time") / F.sum("timed")).alias("avg_processing_time"), F.sum("audio").alias("total_audio_duration_ms"), F.count_distinct("day").alias("active_days"), F.max("last").alias("last_activity"),
    ]


def tenant_user_analytics(keys: DataFrame, bridge: DataFrame, tenants: DataFrame, logs: DataFrame) -> DataFrame:
    """Per the log's tenant and user, with the name of each tenant linked to the log's active key.

    The tenant's name comes through the key, so a key of two tenants puts its logs under both names.
    """
    named = keys.filter("is_active").select(F.col("id").alias("api_key_id")).join(bridge.select("api_key_id", F.col("tenant_id").alias("_t")), "api_key_id", "left")
    named = named.join(tenants.select(F.col("id").alias("_t"), F.col("display_name").alias("tenant_name")), "_t", "left").drop("_t")
    rows = logs_once(logs.filter(F.col("tenant_id").isNotNull() & F.col("user_id").isNotNull()))
    parts = _partials(rows, "tenant_id", "user_id", "api_key_id").join(named, "api_key_id")
    return parts.groupBy("tenant_id", "tenant_name", "user_id").agg(F.sum("n").alias("total_requests"), F.count_distinct("endpoint").alias("unique_endpoints_used"), *_activity(), F.min("first").alias("first_activity"))


def tenant_summary(keys: DataFrame, bridge: DataFrame, tenants: DataFrame, logs: DataFrame) -> DataFrame:
    """Active tenants with the usage of all their keys, inactive keys too; an idle tenant counts 1 row per key link.

    Facts meet the links as partial sums, by an inner join whose skew either side may have; the outer joins are
    between tenants, links and one row per key.
    """
    t = tenants.filter(F.col("status") == "active").select(F.col("id").alias("tenant_id"), F.col("display_name").alias("tenant_name"), "subdomain", "status", F.col("created_at").alias("tenant_created_at"))
    known = keys.select(F.col("id").alias("api_key_id"), F.lit(True).alias("_known"))
    links = bridge.select("tenant_id", "api_key_id").join(known, "api_key_id", "left").select("tenant_id", F.when(F.col("_known"), F.col("api_key_id")).alias("api_key_id"))
    links = links.join(t.select("tenant_id"), "tenant_id")
    rows = logs_once(logs, [c for c in LOG_COLUMNS if c != "tenant_id"]).filter(F.col("api_key_id").isNotNull())
    parts = _partials(rows, "api_key_id", "user_id")
    used = parts.join(links, "api_key_id").groupBy("tenant_id").agg(F.count_distinct("user_id").alias("unique_users"), *_activity())
    per_key = parts.groupBy("api_key_id").agg(F.sum("n").alias("n"))
    counted = t.select("tenant_id").join(links, "tenant_id", "left").join(per_key, "api_key_id", "left").groupBy("tenant_id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("total_requests"))
    x = t.join(counted, "tenant_id").join(used, "tenant_id", "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("unique_users", "active_days", *(f"{e}_requests" for e in BY_TENANT))}
    return x.withColumns(none).select(*t.columns, "unique_users", "total_requests", *[f"{e}_requests" for e in BY_TENANT], "avg_processing_time", "total_audio_duration_ms", "active_days", "last_activity")


def daily_totals(keys: DataFrame, facts: DataFrame, key: str, groups: Sequence[str], at: str, totals: dict[str, str]) -> DataFrame:
    """Totals of facts per active key, groups and day, newest day first (unknown days before all)."""
    active = keys.filter("is_active").select(F.col("id").alias("_k"), F.col("description").alias("_d"))
    day = F.to_date(at).alias("day")
    agg = facts.groupBy(F.col(key).alias("_k"), *groups, day).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in totals.items()])
    return agg.join(active, "_k").select(F.col("_k").alias(key), F.col("_d").alias("description"), *groups, "day", "n", *totals).orderBy(F.desc_nulls_first("day"))


def since(df: DataFrame, at: str, days: int, as_of: datetime) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; a literal bound, so that it is pushed into the scan."""
    return df.filter(F.col(at) >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def first_tenant(bridge: DataFrame) -> DataFrame:
    """One tenant per key, the smallest id, where the links leave the choice open."""
    return bridge.groupBy("api_key_id").agg(F.min("tenant_id").alias("tenant_id"))


def admission(minute: Column, day: Column, month: Column, minute_limit: Column, day_limit: Column, month_limit: Column) -> Column:
    """The first counter at its limit: minute, day, month; null if there is none."""
    return F.when(minute >= minute_limit, "minute").when(day >= day_limit, "day").when(month >= month_limit, "month")


def client_ip(forwarded: Column, real: Column, host: Column) -> Column:
    """First of the forwarded addresses, else the real one, else the host, else ``unknown``; blanks count as absent."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(F.split_part(forwarded, F.lit(","), F.lit(1))), some(real), some(host), F.lit("unknown"))


def subdomain(host: Column) -> Column:
    """First label of a host name without its port."""
    return F.split_part(F.split_part(host, F.lit(":"), F.lit(1)), F.lit("."), F.lit(1))


def without_suffix(host: Column, suffix: str) -> Column:
    """Host name without port and the fixed suffix; differs from ``subdomain`` for hosts of several labels."""
    return F.replace(F.split_part(host, F.lit(":"), F.lit(1)), F.lit(suffix), F.lit(""))


def truthy(flag: Column) -> Column:
    return F.lower(flag).isin("true", "1", "yes", "on")


def is_audio_upload(mime: Column, name: Column) -> Column:
    return F.coalesce(mime.startswith("audio/"), F.lit(False)) | F.coalesce(F.lower(name).rlike(r"\.(wav|mp3|m4a|webm|ogg)$"), F.lit(False))
