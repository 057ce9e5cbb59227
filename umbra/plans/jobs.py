"""Queries over jobs, users, plans, audit lines and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import jobs as J
from umbra.sources.readers import audit_line, audit_lines, table

TIER = "CASE c_custkey % 6 WHEN 0 THEN 'developer' WHEN 1 THEN 'professional' WHEN 2 THEN 'enterprise' WHEN 3 THEN 'unheard-of' WHEN 4 THEN '' END"
DAY = "2024-01-10"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(TIER).alias("tier"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs; every fourth has no user but an address."""
    e = table(spark, sf_dir, "events")
    anonymous = F.col("event_id") % 4 == 0
    return e.select(F.col("event_id").alias("job_id"), F.when(~anonymous, F.col("user_id")).alias("user_id"), F.when(anonymous, F.concat(F.lit("10.0.0."), F.col("user_id") % 9)).alias("ip_address"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))


JOBS = "j AS (SELECT event_id AS job_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || (user_id % 9) END AS ip_address, event_type AS status, ts AS created_at FROM events)"
PLANS = "SELECT n_nationkey AS id, n_name AS name, concat('f', CAST(n_regionkey AS STRING)) AS features, n_nationkey % 4 <> 0 AS active, n_nationkey * 100 AS price_monthly_inr, n_nationkey * 1000 AS price_yearly_inr, 50 - n_nationkey AS price_monthly_usd, 500 - n_nationkey * 10 AS price_yearly_usd FROM nation"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "concat('f', n_regionkey) AS features", "n_nationkey % 4 <> 0 AS active", "n_nationkey * 100 AS price_monthly_inr", "n_nationkey * 1000 AS price_yearly_inr", "50 - n_nationkey AS price_monthly_usd", "500 - n_nationkey * 10 AS price_yearly_usd")


def tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return J.tiers(users, profiles(spark, sf_dir)).select("user_id", "tier")


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.quota(jobs(spark, sf_dir), profiles(spark, sf_dir), DAY)


def anonymous_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.anonymous_quota(jobs(spark, sf_dir), DAY)


def jobs_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.daily(jobs(spark, sf_dir).where("user_id IS NOT NULL"), "user_id").select("user_id", F.col("day").cast("string").alias("day"), "jobs")


def country_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", J.country(F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'de' ELSE '' END"), F.expr("CASE WHEN c_custkey % 3 = 1 THEN 'fr' END"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN '::1' ELSE '9.9.9.9' END")).alias("country"))


def plan_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.catalogue(plans(spark, sf_dir), F.lit("IN")).select("id", "name", "features", "currency", "monthly", "yearly")


def order_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 30 AS INT) AS plan_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS cycle", "CASE WHEN o_orderkey % 3 = 0 THEN 'IN' ELSE 'US' END AS country")
    return J.order_price(o, plans(spark, sf_dir)).select("o_orderkey", F.coalesce("amount", F.lit(-1)).alias("amount"), "currency")


def upgrade_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.lit("enterprise").alias("tier")).distinct()
    return J.upserted(profiles(spark, sf_dir), paid, "id").select("id", F.coalesce("tier", F.lit("-")).alias("tier"))


def delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return J.deleted(profiles(spark, sf_dir), gone, "id").select("id")


def job_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "user_id")


def job_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may see a job: its user, or for one without a user its address. Each job is asked for by its user or another, from nine addresses."""
    rows = jobs(spark, sf_dir).selectExpr("job_id", "user_id", "ip_address", "user_id + CAST(job_id % 3 = 0 AS INT) AS asking_user", "concat('10.0.0.', job_id % 9) AS asking_ip")
    theirs = F.when(F.col("user_id").isNotNull(), F.col("asking_user") == F.col("user_id")).otherwise(F.col("asking_ip") == F.col("ip_address"))
    return rows.select("job_id", F.when(theirs, 200).otherwise(403).alias("answer"))


def tamper_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents are a job's files."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("job"), F.concat(F.lit("f"), "doc_id").alias("path"), F.col("text").alias("content"))
    return J.tamper_hash(d, "job")


def token_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a session, with a token, with one that nobody has, or with neither; who owes nothing has a token."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN user_id END AS session_user", "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('t', user_id) WHEN 2 THEN 'none' END AS action_token")
    tokens = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("t"), "c_custkey").alias("token"), F.col("c_custkey").alias("user_id"))
    return J.token_user(e, tokens).select("event_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


def new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).selectExpr("job_id", "coalesce(user_id, -1) AS user_id", "coalesce(ip_address, '-') AS ip_address", "concat('task', job_id % 3) AS task", "'auto' AS provider", "created_at")
    return J.new_jobs(rows).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "concat('k', c_custkey % 3) AS name", "c_name AS secret_id")


def key_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with keys that are there or not, and with providers that need none."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "CASE event_id % 4 WHEN 0 THEN 'Auto' WHEN 1 THEN 'openai' WHEN 2 THEN 'groq' ELSE 'ollama' END AS provider", "CASE WHEN event_id % 5 > 0 THEN concat('k', event_id % 3) END AS key_name")
    return J.key_reference(e, _keys(spark, sf_dir)).select("event_id", F.coalesce("secret_id", F.lit("-")).alias("secret_id"), F.coalesce("error", F.lit("-")).alias("error"))


def listed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return J.listed_keys(_keys(spark, sf_dir), users)


def job_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second job is in the table, every fifth in memory; users ask for theirs and for others'."""
    every = jobs(spark, sf_dir)
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS job_id", "CASE WHEN event_id % 4 <> 0 THEN user_id + CAST(event_id % 3 = 0 AS INT) END AS asking_user", "concat('10.0.0.', event_id % 9) AS asking_ip")
    memory = every.where("job_id % 5 = 0").withColumn("status", F.lit("running"))
    return J.job_answer(asked, memory, every.where("job_id % 2 = 0")).select("job_id", "code", F.coalesce("status", F.lit("-")).alias("status"))


def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_id") % 3 == 0, "secret").otherwise("identifier").alias("kind"))
    return J.audit_status(m, _log(spark, sf_dir).withColumnRenamed("event_id", "n"))


def cache_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(J.cache_key(F.lit("raw"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "m").otherwise(""), F.col("text")).alias("key"))
    return d.dropDuplicates(["key"])


def allow_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'nonsense' ELSE concat('[\"', c_name, '\", \"b\"]') END")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.array_join(J.allow_list(made), "|"), F.lit("-")).alias("names"))


KEY = "CASE c_custkey % 4 WHEN 0 THEN concat('sk-proj-', c_name) WHEN 1 THEN concat('sk-', c_name) WHEN 2 THEN lpad(CAST(c_custkey AS STRING), 40, 'x') ELSE c_name END"


def key_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", J.key_provider(F.expr(KEY)).alias("provider"))


def provider_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'groq' WHEN 2 THEN 'unheard-of' END")
    keys = F.expr("CASE c_custkey % 3 WHEN 0 THEN array('openai', 'anthropic') WHEN 1 THEN array('anthropic', 'gemini') ELSE array('none') END")
    return c.select("c_custkey", F.coalesce(J.route(name, keys), F.lit("-")).alias("provider"))


def vault_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, wrong = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("<<A>>"), F.col("c_name")).alias("m")).withColumn("blob", J.sealed(F.col("m"), key))
    return rows.select("c_custkey", (J.unsealed(F.col("blob"), key)["<<A>>"] == F.col("m")["<<A>>"]).alias("same"), J.unsealed(F.col("blob"), wrong).isNull().alias("shut"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", audit_line(F.col("ts"), F.upper("event_type"), F.concat(F.lit("user "), "user_id")).alias("value"))


def audit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_lines(_log(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.tail(_log(spark, sf_dir), 50, "event_id").select("event_id", "value")


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, "secret").otherwise("identifier").alias("kind"))
    return J.session_summary(m, "user_id")


def config_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", J.setting(F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'flag' ELSE '' END"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'env' END"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'file' END")).alias("value"))


QUERIES = {f.__name__: f for f in (tier_lookup, daily_quota, anonymous_quota, jobs_per_day, country_rule, plan_catalogue, order_price, upgrade_tier, delete_keys, job_latest_status, job_visible, tamper_hash, cache_key_dedupe, allow_list_parse, key_provider, provider_routing, vault_roundtrip, audit_parse, audit_tail, audit_status, session_summary, config_precedence, token_user, new_jobs, key_reference, listed_keys, job_answers)}

P = f"p AS (SELECT c_custkey AS id, {TIER} AS tier FROM customer)"
LOG = "'[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] ' || upper(event_type) || ' | user ' || user_id"
SQL = {
    "tier_lookup": f"WITH {P} SELECT user_id, coalesce(nullif(tier, ''), 'free') AS tier FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN p ON user_id = id",
    "daily_quota": f"WITH {P}, {JOBS}, t AS (SELECT user_id, count(*) AS jobs FROM j WHERE user_id IS NOT NULL AND created_at >= TIMESTAMP '{DAY}' GROUP BY user_id) SELECT user_id, coalesce(nullif(tier, ''), 'free') AS tier, jobs, jobs < CASE tier WHEN 'developer' THEN 50 WHEN 'professional' THEN 200 WHEN 'enterprise' THEN 500 ELSE 20 END AS allowed FROM t LEFT JOIN p ON user_id = id",
    "anonymous_quota": f"WITH {JOBS} SELECT ip_address, count(*) AS jobs, count(*) < 20 AS allowed FROM j WHERE user_id IS NULL AND created_at >= TIMESTAMP '{DAY}' GROUP BY ip_address",
    "jobs_per_day": f"WITH {JOBS} SELECT user_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS jobs FROM j WHERE user_id IS NOT NULL GROUP BY ALL",
    "country_rule": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DE' WHEN c_custkey % 3 = 1 THEN 'FR' WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'US' END AS country FROM customer",
    "plan_catalogue": f"SELECT id, name, features, 'INR' AS currency, price_monthly_inr AS monthly, price_yearly_inr AS yearly FROM ({PLANS}) WHERE active ORDER BY price_monthly_usd, id",
    "order_price": f"SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN price_yearly_inr ELSE price_monthly_inr END ELSE CASE WHEN o_orderkey % 2 = 0 THEN price_yearly_usd ELSE price_monthly_usd END END, -1) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'INR' ELSE 'USD' END AS currency FROM orders LEFT JOIN ({PLANS}) ON o_custkey % 30 = id",
    "upgrade_tier": f"WITH {P}, c AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT id, coalesce(CASE WHEN c.id IS NOT NULL THEN 'enterprise' ELSE tier END, '-') AS tier FROM p FULL JOIN c USING (id)",
    "delete_keys": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "job_latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "job_visible": "SELECT event_id AS job_id, CASE WHEN (event_id % 4 <> 0 AND event_id % 3 <> 0) OR (event_id % 4 = 0 AND event_id % 9 = user_id % 9) THEN 200 ELSE 403 END AS answer FROM events",
    "tamper_hash": "SELECT doc_id // 10 AS job, sha256(string_agg(coalesce(text, ''), '' ORDER BY 'f' || doc_id, text)) AS hash FROM documents GROUP BY 1",
    "token_user": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 4 = 1 AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN user_id ELSE -1 END AS user_id FROM events",
    "new_jobs": f"WITH {JOBS} SELECT job_id, coalesce(user_id, -1) AS user_id, coalesce(ip_address, '-') AS ip_address, 'pending' AS status, 'task' || (job_id % 3) AS task, 'auto' AS provider, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM j",
    "key_reference": "WITH r AS (SELECT event_id, user_id, event_id % 4 IN (1, 2) AND event_id % 5 > 0 AS wanted, 'k' || (event_id % 3) AS name FROM events) SELECT event_id, coalesce(c_name, '-') AS secret_id, CASE WHEN wanted AND c_name IS NULL THEN 'API key ' || chr(39) || name || chr(39) || ' not found.' ELSE '-' END AS error FROM r LEFT JOIN customer ON wanted AND c_custkey = user_id AND 'k' || (c_custkey % 3) = name",
    "listed_keys": "SELECT c_custkey AS user_id, 'k' || (c_custkey % 3) AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "job_answers": f"WITH {JOBS}, a AS (SELECT event_id AS job_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 <> 0 ELSE event_id % 9 = user_id % 9 END AS own, event_type FROM events) SELECT job_id, CASE WHEN own AND (job_id % 5 = 0 OR job_id % 2 = 0) THEN 200 WHEN job_id % 2 = 0 THEN 403 ELSE 404 END AS code, CASE WHEN NOT own THEN '-' WHEN job_id % 5 = 0 THEN 'running' WHEN job_id % 2 = 0 THEN event_type ELSE '-' END AS status FROM a",
    "audit_status": f"WITH f AS (SELECT user_id AS path, count(*) FILTER (event_id % 3 = 0) AS s, count(*) FILTER (event_id % 3 <> 0) AS i FROM events GROUP BY 1) SELECT 0 AS part, '' AS k, 'session: ' || count(*) || ' files, ' || CAST(sum(s) AS BIGINT) || ' secrets, ' || CAST(sum(i) AS BIGINT) || ' identifiers' AS line FROM f UNION ALL SELECT 1, CAST(path AS VARCHAR), '- ' || path || ': ' || s || ' secrets, ' || i || ' identifiers' FROM f UNION ALL SELECT 2, lpad(CAST(event_id AS VARCHAR), 20, '0'), line FROM (SELECT event_id, {LOG} AS line FROM events ORDER BY event_id DESC LIMIT 5)",
    "cache_key_dedupe": "SELECT DISTINCT 'cache:' || sha256('raw:' || lang || ':' || CASE WHEN doc_id % 2 = 0 THEN 'm' ELSE 'default' END || ':' || text) AS key FROM documents",
    "allow_list_parse": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_name || '|b' END AS names FROM customer",
    "key_provider": f"SELECT c_custkey, CASE WHEN starts_with(k, 'sk-proj-') THEN 'openai' WHEN starts_with(k, 'sk-') THEN 'anthropic' WHEN length(k) > 35 AND length(k) < 45 AND NOT contains(k, '-') THEN 'gemini' ELSE 'unknown' END AS provider FROM (SELECT c_custkey, {KEY} AS k FROM customer)",
    "provider_routing": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'groq' WHEN c_custkey % 4 = 2 THEN '-' WHEN c_custkey % 3 = 0 THEN 'openai' WHEN c_custkey % 3 = 1 THEN 'gemini' ELSE 'ollama' END AS provider FROM customer",
    "vault_roundtrip": "SELECT c_custkey, true AS same, true AS shut FROM customer",
    "audit_parse": "SELECT upper(event_type) AS action, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1",
    "audit_tail": f"SELECT event_id, {LOG} AS value FROM events ORDER BY event_id DESC LIMIT 50",
    "session_summary": "SELECT user_id, count(*) FILTER (event_id % 3 = 0) AS secrets, count(*) FILTER (event_id % 3 <> 0) AS identifiers FROM events GROUP BY user_id",
    "config_precedence": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'flag' WHEN c_custkey % 3 = 0 THEN 'env' WHEN c_custkey % 5 = 0 THEN 'file' ELSE '' END AS value FROM customer",
}
