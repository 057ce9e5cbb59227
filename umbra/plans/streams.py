"""Streaming queries; each is as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources import readers as R
from umbra.sources.folders import shared_folder
from umbra.streaming import jobs as S
from umbra.streaming import machines as M


def stream_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.finished(S.daily_counts(S.opened(spark, sf_dir, "events")), "quota", "complete")
    return rows.select("user_id", F.col("day").cast("string").alias("day"), "jobs")


def stream_ttl_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.first_within(S.opened(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "event_type"), "dedupe", "append")


def stream_job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.latest_states(S.opened(spark, sf_dir, "events"), "user_id"), "states", "complete")


def stream_sse_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.opened(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.expr("CASE WHEN turn >= 6 THEN 'data: [DONE]' WHEN conv_id % 5 = 0 AND turn = 1 THEN 'data: {bad' WHEN conv_id % 7 = 0 AND turn = 0 THEN ': comment' ELSE concat('data: {\"choices\": [{\"delta\": {\"content\": \"t', CAST(turn AS STRING), ' \"}}]}') END").alias("line"))
    return S.finished(S.deltas(lines, "conv_id"), "sse", "complete")


#: Events stand for changes of their user's job; others are no changes.
STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of state, with time-outs after twelve hours."""
    rows = S.finished(M.job_states(S.opened(spark, sf_dir, "events"), "user_id", F.expr(STATUS), limit="12 hours"), "job-states", "append")
    return rows.select("user_id", "status", F.unix_micros("at").alias("at"), "notice")


def stream_response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.finished(M.cache_answers(S.opened(spark, sf_dir, "events"), "user_id", "event_type", ttl="12 hours"), "cache", "append")
    return rows.select("user_id", "event_type", F.col("n").alias("event_id"), "hit")


def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.cache_answers_batch(R.table(spark, sf_dir, "events"), "user_id", "event_type", ttl="12 hours")
    return rows.select("user_id", "event_type", F.col("n").alias("event_id"), "hit")


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers, a line each second; they begin ten seconds apart, and not all of them come to [DONE]."""
    line = F.expr("CASE WHEN turn >= 3 THEN 'data: [DONE]' WHEN conv_id % 5 = 0 AND turn = 1 THEN 'data: {bad' WHEN conv_id % 7 = 0 AND turn = 0 THEN ': comment' ELSE concat('data: {\"choices\": [{\"delta\": {\"content\": \"t', CAST(turn AS STRING), ' \"}}]}') END")
    lines = S.opened(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.timestamp_seconds(F.col("conv_id") * 10 + F.col("turn")).alias("at"), line.alias("line"))
    rows = S.finished(M.streamed_answers(lines, "conv_id", "at"), "answers", "append")
    return rows.select("conv_id", "text", F.unix_seconds("at").alias("at"), "ended")


def stream_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in a log to which the same stream has appended in two runs from one state."""
    at = shared_folder(spark, "audit")
    lines = S.opened(spark, sf_dir, "events").select(R.audit_line(F.col("ts").cast("timestamp"), F.upper("event_type"), F.concat(F.lit("event "), F.col("event_id"))).alias("value"))
    for _ in range(2):
        S.appended_lines(lines, f"{at}/log", f"{at}/state")
    rows = R.audit_lines(R.audit_log(spark, f"{at}/log"))
    return rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "action", "details")


QUERIES = {f.__name__: f for f in (stream_daily_quota, stream_ttl_dedupe, stream_job_lifecycle, stream_sse_concat, stream_job_states, stream_response_cache, response_cache, stream_answers, stream_audit_log)}

#: Of requests by key in order, whether each finds a response; u: the last write, l: twelve hours.
CACHE = """q AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events{until}),
c(user_id, event_type, event_id, k, u, hit) AS (SELECT user_id, event_type, event_id, k, t, false FROM q WHERE k = 1 UNION ALL
SELECT q.user_id, q.event_type, q.event_id, q.k, CASE WHEN t < u + 43200000000 THEN u ELSE t END, t < u + 43200000000 FROM c JOIN q ON q.user_id = c.user_id AND q.event_type = c.event_type AND q.k = c.k + 1)
SELECT user_id, event_type, event_id, hit FROM c"""
#: The watermark: milliseconds of the latest event, less ten minutes, as microseconds.
WATERMARK = "w AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 AS w FROM events)"
RANKED = "CASE {0} WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END"
SQL_STATES = f"""WITH RECURSIVE {WATERMARK},
e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events, w WHERE event_type <> 'click' AND epoch_us(ts) < w),
f(user_id, k, s, t, over, ok, ps, pt) AS (
  SELECT user_id, 0, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, false, NULL::VARCHAR, NULL::BIGINT FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, k, s, t, over, ok, CASE WHEN ok THEN CASE WHEN s IN ('pending', 'running') THEN s END ELSE cs END, CASE WHEN ok THEN t ELSE pt END
  FROM (SELECT *, CASE WHEN cs IS NULL THEN s = 'pending' ELSE {RANKED.format("s")} > {RANKED.format("cs")} END AS ok
        FROM (SELECT e.user_id, e.k, e.s, e.t, CASE WHEN f.ps IS NOT NULL AND f.pt + 43200000000 <= e.t THEN f.pt + 43200000000 END AS over,
                     CASE WHEN f.pt + 43200000000 > e.t THEN f.ps END AS cs, f.pt FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))),
l AS (SELECT user_id, arg_max(ps, k) AS ps, max(pt) AS pt FROM (SELECT user_id, k, coalesce(ps, '') AS ps, pt FROM f) GROUP BY user_id)
SELECT user_id, s AS status, t AS at, NULL::VARCHAR AS notice FROM f WHERE ok
UNION ALL SELECT user_id, 'failed', over, 'timed out' FROM f WHERE over IS NOT NULL
UNION ALL SELECT user_id, 'failed', pt + 43200000000, 'timed out' FROM l, w WHERE ps <> '' AND pt + 43200000000 <= w"""
SQL_ANSWERS = """WITH x AS (SELECT conv_id, turn, conv_id * 10 + turn AS tm, CASE WHEN turn >= 3 THEN '!' WHEN conv_id % 5 = 0 AND turn = 1 THEN '' WHEN conv_id % 7 = 0 AND turn = 0 THEN NULL ELSE 't' || turn || ' ' END AS c FROM conversations),
w AS (SELECT max(tm) - 10 AS w FROM x), y AS (SELECT x.*, w FROM x, w WHERE tm < w AND c IS NOT NULL),
g AS (SELECT conv_id, coalesce(string_agg(c, '' ORDER BY turn) FILTER (c <> '!'), '') AS text, min(tm) FILTER (c = '!') AS done, max(tm) FILTER (c <> '!') AS last, any_value(w) AS w FROM y GROUP BY conv_id)
SELECT conv_id, text, CAST(coalesce(done, last + 60) AS BIGINT) AS at, CASE WHEN done IS NULL THEN 'idle' ELSE 'done' END AS ended FROM g WHERE done IS NOT NULL OR last + 60 <= w"""
SQL = {
    "stream_daily_quota": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS jobs FROM events GROUP BY ALL",
    "stream_ttl_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_job_lifecycle": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "stream_sse_concat": "SELECT conv_id, coalesce(string_agg(CASE WHEN turn >= 6 OR (conv_id % 5 = 0 AND turn = 1) OR (conv_id % 7 = 0 AND turn = 0) THEN '' ELSE 't' || turn || ' ' END, '' ORDER BY turn), '') AS text FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 0) GROUP BY conv_id",
    "stream_job_states": SQL_STATES,
    "stream_response_cache": f"WITH RECURSIVE {WATERMARK}, " + CACHE.format(until=", w WHERE epoch_us(ts) < w"),
    "response_cache": "WITH RECURSIVE " + CACHE.format(until=""),
    "stream_answers": SQL_ANSWERS,
    "stream_audit_log": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, upper(event_type) AS action, 'event ' || event_id AS details FROM events",
}
