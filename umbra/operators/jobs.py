"""Jobs, quotas, prices, keys, audit and integrity over ordinary tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a tier may do.
TIERS = [("free", 20, 5), ("developer", 50, 20), ("professional", 200, 50), ("enterprise", 500, 100)]
CACHE_SECONDS = 3600


def tier_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "tier string, max_jobs_per_day int, max_files int")


def tiers(users: DataFrame, profiles: DataFrame, user: str = "user_id") -> DataFrame:
    """users with tier: their profile's, or free."""
    known = profiles.select(F.col("id").alias("_id"), F.nullif("tier", F.lit("")).alias("_tier"))
    return users.join(known, F.col(user) == F.col("_id"), "left").withColumn("tier", F.coalesce("_tier", F.lit("free"))).drop("_id", "_tier")


def daily(jobs: DataFrame, *by: str, at: str = "created_at") -> DataFrame:
    return jobs.groupBy(*by, F.to_date(at).alias("day")).agg(F.count("*").alias("jobs"))


def quota(jobs: DataFrame, profiles: DataFrame, day: str) -> DataFrame:
    """user_id, tier, jobs, allowed of each user with jobs from the day's start on; at the limit no more are allowed."""
    spark = jobs.sparkSession
    today = jobs.where(F.col("user_id").isNotNull() & (F.col("created_at") >= F.lit(day).cast("timestamp_ntz"))).groupBy("user_id").agg(F.count("*").alias("jobs"))
    limits = F.broadcast(tier_limits(spark).select(F.col("tier").alias("_t"), "max_jobs_per_day"))
    rows = tiers(today, profiles).join(limits, F.col("tier") == F.col("_t"), "left")
    return rows.select("user_id", "tier", "jobs", (F.col("jobs") < F.coalesce("max_jobs_per_day", F.lit(TIERS[0][1]))).alias("allowed"))


def anonymous_quota(jobs: DataFrame, day: str) -> DataFrame:
    """The same by address for jobs without a user, with the free limit."""
    today = jobs.where(F.col("user_id").isNull() & (F.col("created_at") >= F.lit(day).cast("timestamp_ntz"))).groupBy("ip_address").agg(F.count("*").alias("jobs"))
    return today.withColumn("allowed", F.col("jobs") < TIERS[0][1])


def token_user(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests (session_user, action_token) with user_id: the session's user, else the token's (tokens: token, user_id), else null."""
    known = tokens.select(F.col("token").alias("_token"), F.col("user_id").alias("_user"))
    joined = requests.drop("user_id").join(known, F.nullif(F.col("action_token"), F.lit("")) == F.col("_token"), "left")
    return joined.withColumn("user_id", F.coalesce("session_user", "_user")).drop("_token", "_user")


def new_jobs(requests: DataFrame) -> DataFrame:
    """A row of the job table for each request (job_id, user_id, ip_address, task, provider, created_at), pending."""
    return requests.select("job_id", "user_id", "ip_address", F.lit("pending").alias("status"), "task", "provider", "created_at")


def inserted(jobs: DataFrame, path: str) -> None:
    """Appends jobs to the table in a folder."""
    jobs.write.mode("append").parquet(path)


def key_reference(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (user_id, provider, key_name) with secret_id and error; keys: user_id, name, secret_id.

    The automatic and the local provider need no key, nor does a request that names none. Of a name given twice the
    smallest secret counts.
    """
    known = keys.groupBy(F.col("user_id").alias("_user"), F.col("name").alias("_name")).agg(F.min("secret_id").alias("_secret"))
    wanted = ~F.lower("provider").isin("auto", "ollama") & (F.coalesce("key_name", F.lit("")) != "")
    joined = requests.join(known, wanted & (F.col("user_id") == F.col("_user")) & (F.col("key_name") == F.col("_name")), "left")
    error = F.when(wanted & F.col("_secret").isNull(), F.concat(F.lit("API key '"), "key_name", F.lit("' not found.")))
    return joined.withColumns({"secret_id": F.col("_secret"), "error": error}).drop("_user", "_name", "_secret")


def listed_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    """The names of the keys of users (user_id), never the keys."""
    return keys.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "name").distinct()


def job_answer(requests: DataFrame, memory: DataFrame, table: DataFrame) -> DataFrame:
    """requests (job_id, asking_user, asking_ip) with code and status: what of a job the asking user, or address without one, may see.

    A job that is in memory and theirs is answered from there, else the table is asked: 404 if it has none, 403 if it is
    another's. memory, table: job_id, user_id, ip_address, status, a row for each job.
    """
    def of(jobs: DataFrame, side: str) -> DataFrame:
        return jobs.select(F.col("job_id").alias(f"{side}_id"), F.col("user_id").alias(f"{side}_user"), F.col("ip_address").alias(f"{side}_ip"), F.col("status").alias(f"{side}_status"))

    def theirs(side: str) -> Column:
        own = F.when(F.col("asking_user").isNotNull(), F.col("asking_user") == F.col(f"{side}_user")).otherwise(F.col("asking_ip") == F.col(f"{side}_ip"))
        return F.coalesce(F.col(f"{side}_id").isNotNull() & own, F.lit(False))

    joined = requests.join(of(memory, "m"), F.col("job_id") == F.col("m_id"), "left").join(of(table, "t"), F.col("job_id") == F.col("t_id"), "left")
    code = F.when(theirs("m") | theirs("t"), 200).when(F.col("t_id").isNull(), 404).otherwise(403)
    status = F.when(theirs("m"), F.col("m_status")).when(theirs("t"), F.col("t_status"))
    return joined.select(*requests.columns, code.alias("code"), status.alias("status"))


def country(edge: Column, proxy: Column, ip: Column) -> Column:
    given = F.coalesce(F.nullif(edge, F.lit("")), F.nullif(proxy, F.lit("")))
    return F.when(given.isNotNull(), F.upper(given)).when(ip.isin("127.0.0.1", "localhost", "::1"), "IN").otherwise("US")


def catalogue(plans: DataFrame, land: Column) -> DataFrame:
    """Active plans with the prices of a country, cheapest first."""
    inr = land == "IN"
    return plans.where("active").select("id", "name", "features", F.when(inr, "INR").otherwise("USD").alias("currency"), F.when(inr, F.col("price_monthly_inr")).otherwise(F.col("price_monthly_usd")).alias("monthly"), F.when(inr, F.col("price_yearly_inr")).otherwise(F.col("price_yearly_usd")).alias("yearly"), "price_monthly_usd").orderBy("price_monthly_usd", "id")


def order_price(orders: DataFrame, plans: DataFrame) -> DataFrame:
    """orders (plan_id, cycle, country) with amount and currency; unknown plans have none."""
    p = plans.select(F.col("id").alias("_id"), *[c for c in plans.columns if c.startswith("price_")])
    inr, year = F.col("country") == "IN", F.col("cycle") == "yearly"
    amount = F.when(inr, F.when(year, F.col("price_yearly_inr")).otherwise(F.col("price_monthly_inr"))).otherwise(F.when(year, F.col("price_yearly_usd")).otherwise(F.col("price_monthly_usd")))
    return orders.join(p, F.col("plan_id") == F.col("_id"), "left").select(*orders.columns, amount.alias("amount"), F.when(inr, "INR").otherwise("USD").alias("currency"))


def upserted(rows: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """rows with the changes in place of rows of the same keys; new keys are added."""
    return rows.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def deleted(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def latest(events: DataFrame, *by: str, at: str = "ts", tie: str = "event_id", value: str = "status") -> DataFrame:
    """The last state of each key."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def tamper_hash(files: DataFrame, *by: str, path: str = "path", content: str = "content") -> DataFrame:
    """SHA-256 of each group's contents in order of path (by code point), as the rows pass.

    A group's rows come sorted to one task, which holds the digest so far and one batch: no group is ever one row.
    """
    kinds = dict(files.dtypes)
    rows = files.select(*by, F.coalesce(path, F.lit("")).alias("_path"), F.coalesce(content, F.lit("")).alias("_content"))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "_path", "_content").select(*by, "_content")
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            for k, text in zip(keys, batch.column(n), strict=True):
                if digest is None or k != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(text.as_buffer())
            if done:
                yield made(done, batch.schema)
        if digest is not None:
            yield made([(*key, digest.hexdigest())], batch.schema)

    def made(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(columns[i], schema.field(i).type) for i in range(n)), pa.array(columns[n], pa.string())], names=[*by, "hash"])

    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "hash string"]))


def cache_key(kind: Column, provider: Column, model: Column, prompt: Column) -> Column:
    return F.concat(F.lit("cache:"), F.sha2(F.concat_ws(":", kind, provider, F.coalesce(F.nullif(model, F.lit("")), F.lit("default")), prompt), 256))


def allow_list(text: Column) -> Column:
    """The names of a JSON list; null if it isn't one."""
    return F.from_json(text, "array<string>")


def key_provider(key: Column) -> Column:
    return F.when(key.startswith("sk-proj-"), "openai").when(key.startswith("sk-"), "anthropic").when((F.length(key) > 35) & (F.length(key) < 45) & ~key.contains("-"), "gemini").otherwise("unknown")


#: The providers that can be named.
PROVIDERS = ["ollama", "openai", "anthropic", "gemini", "deepseek", "mistral", "qwen", "groq", "openrouter"]


def route(name: Column, keys: Column) -> Column:
    """The provider for a name, null if there is none such; auto (or null) takes the first that has a key (array of providers), ollama needs none."""
    asked = F.coalesce(name, F.lit("auto"))
    auto = F.when(F.array_contains(keys, "gemini"), "gemini").when(F.array_contains(keys, "openai"), "openai").when(F.array_contains(keys, "anthropic"), "anthropic").otherwise("ollama")
    return F.when(asked == "auto", auto).when(asked.isin(PROVIDERS), asked)


def sealed(mapping: Column, key: Column) -> Column:
    """A map as an encrypted blob; key of 16, 24 or 32 bytes."""
    return F.aes_encrypt(F.to_json(mapping), key)


def unsealed(blob: Column, key: Column) -> Column:
    """The map again; null with the wrong key."""
    return F.from_json(F.try_aes_decrypt(blob, key).cast("string"), "map<string,string>")


def tail(lines: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n lines: a report of that length."""
    return lines.orderBy(*[F.desc(c) for c in order]).limit(n)


def audit_status(mapping: DataFrame, lines: DataFrame, by: str = "path", value: str = "value", order: str = "n") -> DataFrame:
    """n, line: what was hidden in the session and in each file, then the last five lines of the log (value, in order of n)."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("secret", "identifier")]
    files = mapping.groupBy(by).agg(*kinds)
    said = lambda head: F.concat(head, "secret", F.lit(" secrets, "), "identifier", F.lit(" identifiers"))
    whole = files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("secret", "identifier")])
    top = whole.select(F.lit(0).alias("part"), F.lit("").alias("k"), said(F.concat(F.lit("session: "), "files", F.lit(" files, "))).alias("line"))
    each = files.select(F.lit(1).alias("part"), F.col(by).cast("string").alias("k"), said(F.concat(F.lit("- "), F.col(by).cast("string"), F.lit(": "))).alias("line"))
    last = lines.orderBy(F.desc(order)).limit(5).select(F.lit(2).alias("part"), F.lpad(F.col(order).cast("string"), 20, "0").alias("k"), F.col(value).alias("line"))
    return top.unionByName(each).unionByName(last)


def session_summary(mapping: DataFrame, *by: str) -> DataFrame:
    """Secrets and identifiers hidden, by the mapping's kind."""
    return mapping.groupBy(*by).agg(F.count_if(F.col("kind") == "secret").alias("secrets"), F.count_if(F.col("kind") == "identifier").alias("identifiers"))


def setting(flag: Column, env: Column, file: Column) -> Column:
    """A flag before the environment before the file."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (flag, env, file)], F.lit(""))
