"""Queries of usage, limits and table maintenance."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent.functions import text
from veloquent.operators import ratelimit, upsert, usage
from veloquent.tables import once, table

AS_OF = datetime(2025, 5, 1, tzinfo=timezone.utc)


def _dims(spark: SparkSession, d: str):
    return [table(spark, d, t) for t in ("api_keys", "api_keys_tenants", "tenants", "api_usage_logs")]


def usage_by_key(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_by_key(table(spark, d, "api_keys"), table(spark, d, "api_usage_logs"))


def usage_by_key_tenant(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_by_key_tenant(*_dims(spark, d))


def tenant_user_analytics(spark: SparkSession, d: str) -> DataFrame:
    return usage.tenant_user_analytics(*_dims(spark, d)).orderBy(F.desc_nulls_first("total_requests"), "tenant_id", "tenant_name", "user_id")


def tenant_summary(spark: SparkSession, d: str) -> DataFrame:
    return usage.tenant_summary(*_dims(spark, d)).orderBy(F.desc_nulls_last("total_requests"), "tenant_id")


def ai_costs_daily(spark: SparkSession, d: str) -> DataFrame:
    """Totals per key, kind and day; order lines stand in for interactions, customers for keys."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("description"), (F.col("c_acctbal") > 0).alias("is_active"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = lines.select(F.col("o_custkey"), F.col("l_returnflag"), F.col("l_linestatus"), "l_shipdate", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("c"))
    totals = usage.daily_totals(keys, facts, "o_custkey", ["l_returnflag", "l_linestatus"], "l_shipdate", {"total_tokens": "q", "total_cost": "c"})
    return totals.withColumn("total_cost", F.col("total_cost").cast("double"))  # summed exactly, then widened


def recent_logs(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "api_usage_logs").select("id", "api_key_id", "endpoint", "created_at")
    recent = once(usage.since(logs, "created_at", 30, AS_OF), "id", "api_key_id", "endpoint", "created_at")
    return recent.orderBy(F.desc_nulls_first("created_at"), "id")


def tenant_first_key(spark: SparkSession, d: str) -> DataFrame:
    """Every tenant with its links' smallest key or null: a lookup per row as one left join."""
    links = table(spark, d, "api_keys_tenants").groupBy("tenant_id").agg(F.min("api_key_id").alias("api_key_id"))
    t = table(spark, d, "tenants").select(F.col("id").alias("tenant_id"), "subdomain")
    return t.join(links, "tenant_id", "left").select("tenant_id", "subdomain", F.coalesce("api_key_id", F.lit("")).alias("api_key_id"))


def first_tenant(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "api_keys").select(F.col("id").alias("api_key_id"))
    return keys.join(usage.first_tenant(table(spark, d, "api_keys_tenants")), "api_key_id", "left")


def cross_join_seed(spark: SparkSession, d: str) -> DataFrame:
    """Links of every key with the one tenant of a single-row table."""
    one = table(spark, d, "tenants").agg(F.min("subdomain").alias("subdomain"))
    return table(spark, d, "api_keys").select(F.col("id").alias("api_key_id")).crossJoin(F.broadcast(one))  # one row


def config_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Host name to subdomain to tenant."""
    hosts = table(spark, d, "tenants").select(F.concat(F.coalesce("subdomain", F.lit("x")), F.lit(".example.org:8443")).alias("host"))
    named = hosts.withColumn("subdomain", usage.without_suffix(F.col("host"), ".example.org")).withColumn("first_label", usage.subdomain(F.col("host")))
    return named.join(table(spark, d, "tenants").select("subdomain", F.col("id").alias("tenant_id"), "status"), "subdomain", "left").select("host", "subdomain", "first_label", "tenant_id", "status")


def client_ip(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "api_usage_logs"), "id", "ip_address")
    ip = F.col("ip_address")
    return rows.select("id", usage.client_ip(F.concat(ip, F.lit(" , 10.0.0.1")), F.lit(None).cast("string"), F.lit("host")).alias("ip"))


def truthy_flags(spark: SparkSession, d: str) -> DataFrame:
    logs = once(table(spark, d, "api_usage_logs"), "id", "deep_analysis", "use_audio")
    text = F.when(F.col("deep_analysis"), F.when(F.col("use_audio"), "1").otherwise("TRUE")).otherwise("off")
    return logs.select("id", usage.truthy(text).alias("wide"), (F.lower(text) == "true").alias("strict"))


def upload_check(spark: SparkSession, d: str) -> DataFrame:
    logs = once(table(spark, d, "api_usage_logs"), "id", "endpoint", "use_audio")
    name = F.concat(F.col("endpoint"), F.when(F.col("use_audio"), ".WAV").otherwise(".txt"))
    mime = F.when(F.col("endpoint") == "transcribe", "audio/mpeg")
    return logs.select("id", usage.is_audio_upload(mime, name).alias("is_audio"))


def rate_limit_counters(spark: SparkSession, d: str) -> DataFrame:
    return ratelimit.counters(table(spark, d, "api_usage_logs"))


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return ratelimit.decisions(table(spark, d, "api_usage_logs"), table(spark, d, "api_keys"))


def admission_reason(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    why = usage.admission(c("minute_usage"), c("daily_usage"), c("monthly_usage"), c("minute_limit"), c("daily_limit"), c("monthly_limit"))
    return table(spark, d, "api_keys").select("id", why.alias("denied_by"))


def counter_reset(spark: SparkSession, d: str) -> DataFrame:
    """Counters whose stored period lies before the current one start again at 0."""
    k, now = table(spark, d, "api_keys"), F.lit(AS_OF)
    out = [F.col("id")]
    for n, last, period in (("minute", "last_minute_reset", "minute"), ("daily", "last_daily_reset", "day"), ("monthly", "last_monthly_reset", "month")):
        start = F.date_trunc(period, now) if period == "minute" else F.to_date(F.date_trunc(period, now))
        old = F.col(last) < start
        out += [F.when(old, 0).otherwise(F.col(f"{n}_usage")).alias(f"{n}_usage"), F.when(old, start).otherwise(F.col(last)).alias(last)]
    return k.select(*out)


def elapsed_ms(spark: SparkSession, d: str) -> DataFrame:
    """Whole milliseconds from a key's making to its last use."""
    return table(spark, d, "api_keys").select("id", text.elapsed_ms(F.col("created_at"), F.col("last_used_at")).alias("elapsed"))


_KEY_STATE = ["id", "usage_count", "updated_at"]


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Keys brought up to date by the counts of their logs."""
    old = table(spark, d, "api_keys").select(*_KEY_STATE)
    logs = once(table(spark, d, "api_usage_logs").filter(F.col("api_key_id").isNotNull()), "id", "api_key_id", "created_at")
    new = logs.groupBy(F.col("api_key_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("usage_count"), F.max("created_at").alias("updated_at"))
    return upsert.upsert(old, new, ["id"], "updated_at")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "api_keys_tenants").select("api_key_id", "tenant_id").distinct()
    seen = table(spark, d, "api_usage_logs").filter("api_key_id IS NOT NULL AND tenant_id IS NOT NULL").select("api_key_id", "tenant_id").distinct()
    return upsert.insert_absent(links, seen, ["api_key_id", "tenant_id"])


def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "api_keys").select("id", "description", "daily_limit")
    changes = table(spark, d, "api_keys").select("id", F.when(F.col("is_active"), F.concat(F.lit("on: "), "description")).alias("description"))
    return upsert.patch(keys, changes, ["id"])


QUERIES = {
    f.__name__: f
    for f in (
        usage_by_key, usage_by_key_tenant, tenant_user_analytics, tenant_summary, ai_costs_daily, recent_logs, tenant_first_key, first_tenant, cross_join_seed, config_by_host, client_ip,
        truthy_flags, upload_check, rate_limit_counters, rate_limit_decisions, admission_reason, counter_reset, elapsed_ms, upsert_latest, insert_if_absent, patch_rows,
    )
}

_L = "(SELECT DISTINCT id, api_key_id, endpoint, deep_analysis, use_audio, processing_time_ms, audio_duration_ms, created_at, tenant_id, user_id FROM api_usage_logs)"
_SUMS = """CAST(COUNT(DISTINCT CAST(l.created_at AS DATE)) AS BIGINT) AS active_days, AVG(l.processing_time_ms) AS avg_processing_time,
  CAST(SUM(CASE WHEN l.endpoint = 'pronunciation' THEN 1 ELSE 0 END) AS BIGINT) AS pronunciation_requests, CAST(SUM(CASE WHEN l.endpoint = 'scripted' THEN 1 ELSE 0 END) AS BIGINT) AS scripted_requests,
  CAST(SUM(CASE WHEN l.endpoint = 'unscripted' THEN 1 ELSE 0 END) AS BIGINT) AS unscripted_requests"""
_KEYS = "CAST(SUM(CASE WHEN l.deep_analysis THEN 1 ELSE 0 END) AS BIGINT) AS deep_analysis_requests, CAST(SUM(CASE WHEN l.use_audio THEN 1 ELSE 0 END) AS BIGINT) AS audio_requests, MAX(l.created_at) AS last_request_at, MIN(l.created_at) AS first_request_at"
_TENANTS = "CAST(SUM(CASE WHEN l.endpoint = 'transcribe' THEN 1 ELSE 0 END) AS BIGINT) AS transcribe_requests, CAST(SUM(l.audio_duration_ms) AS BIGINT) AS total_audio_duration_ms, MAX(l.created_at) AS last_activity"

ORACLES = {
    "usage_by_key": f"SELECT k.id AS api_key_id, k.description AS api_key_description, COUNT(*) AS total_requests, {_SUMS}, {_KEYS} FROM api_keys k LEFT JOIN {_L} l ON k.id = l.api_key_id WHERE k.is_active GROUP BY k.id, k.description",
    "usage_by_key_tenant": f"SELECT k.id AS api_key_id, k.description AS api_key_description, b.tenant_id, t.subdomain AS tenant_subdomain, t.display_name AS tenant_display_name, COUNT(l.id) AS total_requests, {_SUMS}, {_KEYS} FROM api_keys k LEFT JOIN api_keys_tenants b ON k.id = b.api_key_id LEFT JOIN tenants t ON b.tenant_id = t.id LEFT JOIN {_L} l ON k.id = l.api_key_id WHERE k.is_active GROUP BY k.id, k.description, b.tenant_id, t.subdomain, t.display_name",
    "tenant_user_analytics": f"SELECT l.tenant_id, t.display_name AS tenant_name, l.user_id, COUNT(*) AS total_requests, COUNT(DISTINCT l.endpoint) AS unique_endpoints_used, {_SUMS}, {_TENANTS}, MIN(l.created_at) AS first_activity FROM {_L} l LEFT JOIN api_keys k ON l.api_key_id = k.id LEFT JOIN api_keys_tenants b ON k.id = b.api_key_id LEFT JOIN tenants t ON b.tenant_id = t.id WHERE k.is_active AND l.tenant_id IS NOT NULL AND l.user_id IS NOT NULL GROUP BY l.tenant_id, t.display_name, l.user_id",
    "tenant_summary": f"SELECT t.id AS tenant_id, t.display_name AS tenant_name, t.subdomain, t.status, COUNT(DISTINCT l.user_id) AS unique_users, COUNT(*) AS total_requests, {_SUMS}, {_TENANTS}, t.created_at AS tenant_created_at FROM tenants t LEFT JOIN api_keys_tenants b ON t.id = b.tenant_id LEFT JOIN api_keys k ON b.api_key_id = k.id LEFT JOIN {_L} l ON k.id = l.api_key_id WHERE t.status = 'active' GROUP BY t.id, t.display_name, t.subdomain, t.status, t.created_at",
    "ai_costs_daily": "SELECT o_custkey, c_name AS description, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_tokens, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL",
    "recent_logs": "SELECT DISTINCT id, api_key_id, endpoint, created_at FROM api_usage_logs WHERE created_at >= TIMESTAMPTZ '2025-04-01 00:00:00+00'",
    "tenant_first_key": "SELECT t.id AS tenant_id, t.subdomain, coalesce(min(b.api_key_id), '') AS api_key_id FROM tenants t LEFT JOIN api_keys_tenants b ON b.tenant_id = t.id GROUP BY t.id, t.subdomain",
    "first_tenant": "SELECT k.id AS api_key_id, min(b.tenant_id) AS tenant_id FROM api_keys k LEFT JOIN api_keys_tenants b ON b.api_key_id = k.id GROUP BY k.id",
    "cross_join_seed": "SELECT k.id AS api_key_id, s.subdomain FROM api_keys k CROSS JOIN (SELECT min(subdomain) AS subdomain FROM tenants) s",
    "config_by_host": "SELECT coalesce(t.subdomain, 'x') || '.example.org:8443' AS host, coalesce(t.subdomain, 'x') AS subdomain, split_part(coalesce(t.subdomain, 'x'), '.', 1) AS first_label, u.id AS tenant_id, u.status FROM tenants t LEFT JOIN tenants u ON u.subdomain = coalesce(t.subdomain, 'x')",
    "client_ip": "SELECT DISTINCT id, coalesce(nullif(trim(ip_address), ''), 'host') AS ip FROM api_usage_logs",
    "truthy_flags": "SELECT DISTINCT id, coalesce(deep_analysis, false) AS wide, coalesce(deep_analysis, false) AND NOT coalesce(use_audio, false) AS strict FROM api_usage_logs",
    "upload_check": "SELECT DISTINCT id, coalesce(endpoint = 'transcribe', false) OR (endpoint IS NOT NULL AND coalesce(use_audio, false)) AS is_audio FROM api_usage_logs",
    "rate_limit_counters": f"""WITH l AS (SELECT * FROM {_L} WHERE created_at IS NOT NULL)
SELECT api_key_id, period, period_start, count(*) AS n FROM (SELECT api_key_id, 'minute' AS period, date_trunc('minute', created_at) AS period_start FROM l
  UNION ALL SELECT api_key_id, 'day', CAST(date_trunc('day', created_at) AS TIMESTAMPTZ) FROM l UNION ALL SELECT api_key_id, 'month', CAST(date_trunc('month', created_at) AS TIMESTAMPTZ) FROM l) GROUP BY ALL""",
    "rate_limit_decisions": f"""WITH l AS (SELECT l.id, l.api_key_id, l.created_at, coalesce(minute_limit, 2147483647) AS ml, coalesce(daily_limit, 2147483647) AS dl, coalesce(monthly_limit, 2147483647) AS nl FROM {_L} l LEFT JOIN api_keys k ON k.id = l.api_key_id WHERE l.created_at IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY api_key_id, date_trunc('minute', created_at) ORDER BY created_at, id) <= ml AS ok1 FROM l),
b AS (SELECT *, ok1 AND sum(CAST(ok1 AS INT)) OVER (PARTITION BY api_key_id, date_trunc('day', created_at) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) <= dl AS ok2 FROM a),
c AS (SELECT *, ok2 AND sum(CAST(ok2 AS INT)) OVER (PARTITION BY api_key_id, date_trunc('month', created_at) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) <= nl AS ok3 FROM b)
SELECT id, api_key_id, created_at, CASE WHEN NOT ok1 THEN 'minute' WHEN NOT ok2 THEN 'day' WHEN NOT ok3 THEN 'month' END AS denied_by FROM c""",
    "admission_reason": "SELECT id, CASE WHEN minute_usage >= minute_limit THEN 'minute' WHEN daily_usage >= daily_limit THEN 'day' WHEN monthly_usage >= monthly_limit THEN 'month' END AS denied_by FROM api_keys",
    "counter_reset": """SELECT id, CASE WHEN last_minute_reset < TIMESTAMPTZ '2025-05-01 00:00:00+00' THEN 0 ELSE minute_usage END AS minute_usage,
  CASE WHEN last_minute_reset < TIMESTAMPTZ '2025-05-01 00:00:00+00' THEN TIMESTAMPTZ '2025-05-01 00:00:00+00' ELSE last_minute_reset END AS last_minute_reset,
  CASE WHEN last_daily_reset < DATE '2025-05-01' THEN 0 ELSE daily_usage END AS daily_usage, CASE WHEN last_daily_reset < DATE '2025-05-01' THEN DATE '2025-05-01' ELSE last_daily_reset END AS last_daily_reset,
  CASE WHEN last_monthly_reset < DATE '2025-05-01' THEN 0 ELSE monthly_usage END AS monthly_usage, CASE WHEN last_monthly_reset < DATE '2025-05-01' THEN DATE '2025-05-01' ELSE last_monthly_reset END AS last_monthly_reset FROM api_keys""",
    "elapsed_ms": "SELECT id, CAST(floor((epoch_us(last_used_at) - epoch_us(created_at)) / 1000) AS BIGINT) AS elapsed FROM api_keys",
    "upsert_latest": f"""WITH n AS (SELECT api_key_id AS id, CAST(count(*) AS INT) AS usage_count, max(created_at) AS updated_at FROM {_L} WHERE api_key_id IS NOT NULL GROUP BY 1),
u AS (SELECT id, usage_count, updated_at, 0 AS f FROM api_keys UNION ALL SELECT *, 1 FROM n)
SELECT id, usage_count, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, f DESC) AS rn FROM u) WHERE rn = 1""",
    "insert_if_absent": "SELECT DISTINCT api_key_id, tenant_id FROM api_keys_tenants UNION SELECT DISTINCT api_key_id, tenant_id FROM api_usage_logs WHERE api_key_id IS NOT NULL AND tenant_id IS NOT NULL",
    "patch_rows": "SELECT id, CASE WHEN is_active AND description IS NOT NULL THEN 'on: ' || description ELSE description END AS description, daily_limit FROM api_keys",
}
