"""State machines over keyed streams, each key's rows in order of event time: job states, a response cache, streamed answers.

Rows wait until the watermark has passed them and are then taken in order of time and number, whatever batch they came in;
a row that the watermark had passed before it came is dropped. So results don't depend on batches, and those of the batch
twins (the same rule over a sorted group, or by joins) are the same up to the watermark. What a key holds is what waits
within the watermark's delay and one small state, which ends by itself at its deadline; then nothing is left of the key.
State is kept by RocksDB, so it needn't fit into memory; a task holds that of one bucket of keys at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from umbra.sources.folders import Rounds, settings

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Machine:
    """What is done with a row and at a deadline. A state is None or a tuple of texts, numbers and truths; times are microseconds."""

    OUT: str  # columns after the key

    def row(self, state: tuple | None, at: int, n: int, value: str | None) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int:
        raise NotImplementedError

    def ended(self, state: tuple) -> list[tuple]:
        """What comes out when the deadline has passed and the state goes."""
        raise NotImplementedError

    def step(self, state: tuple | None, at: int, n: int, value: str | None) -> tuple[tuple | None, list[tuple]]:
        """A row, with the end of a state whose deadline lies before it."""
        out = []
        if state is not None and self.deadline(state) <= at:
            out, state = self.ended(state), None
        state, more = self.row(state, at, n, value)
        return state, out + more


#: Keys are dealt into so many buckets, a group of the stream each: calls to the state store, of a millisecond or so each, are
#: made for a bucket and not for a key. Part of what a stream's state means: another number needs a new state folder.
BUCKETS = 1024


class InOrder(StatefulProcessor):
    """Runs a machine on rows key, at, n, value of a bucket of keys, each key's in order; states and rows that wait are JSON."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getValueState("held", "states string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for batch in rows:
            new = [(k, int(a), int(n), v) for k, a, n, v in zip(batch["key"], batch["at"], batch["n"], batch["value"], strict=True)]
            if new:
                self.waiting.appendValue((json.dumps(new),))
                first.append(min(r[1] for r in new))
        if first:
            self._timed(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, left, out = [], [], []
        for (part,) in self.waiting.get():
            for r in json.loads(part):
                (due if r[1] < passed else left).append(r)
        due.sort(key=lambda r: (r[0], r[1], r[2], r[3] or ""))
        states = {k: tuple(s) for k, s in json.loads(self.held.get()[0])} if self.held.exists() else {}
        for k, *r in due:
            state, more = self.machine.step(states.pop(k, None), *r)
            if state is not None:
                states[k] = state
            out += [(k, *x) for x in more]
        for k in [k for k, s in states.items() if self.machine.deadline(s) <= passed]:
            out += [(k, *x) for x in self.machine.ended(states.pop(k))]
        self.waiting.clear() if not left else self.waiting.put([(json.dumps(left),)])
        self.held.clear() if not states else self.held.update((json.dumps(list(states.items())),))
        times = [r[1] for r in left] + [self.machine.deadline(s) for s in states.values()]
        if times:
            self._timed(min(times), passed)
        if out:
            yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in self.machine.OUT.split(", "))])

    def _timed(self, at: int, passed: int = 0) -> None:
        """One timer: the millisecond after the earliest time at which there is something to do."""
        at = max(at, passed) // 1000 + 1
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at and min(timers) * 1000 > passed:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


#: Keys as text and back, to the microsecond.
AS_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def run(machine: Machine, stream: DataFrame, keys: list[str], at: str, n: str, value: Column, late: str) -> DataFrame:
    """keys and the machine's columns, in append mode; late: how far behind the latest row one may come."""
    key = F.to_json(F.struct(*keys), AS_JSON)
    rows = stream.select(key.alias("key"), F.col(at).cast("timestamp").alias("_at"), F.col(n).cast("long").alias("n"), value.cast("string").alias("value"))
    rows = rows.where("_at IS NOT NULL").withWatermark("_at", late).withColumns({"at": F.unix_micros("_at"), "bucket": F.pmod(F.xxhash64("key"), F.lit(BUCKETS))})
    kinds, names = dict(stream.dtypes), [c.split()[0] for c in machine.OUT.split(", ")]
    out = rows.groupBy("bucket").transformWithStateInPandas(InOrder(machine), f"key string, {machine.OUT}", "Append", "EventTime")
    return out.select(F.from_json("key", ", ".join(f"`{k}` {kinds[k]}" for k in keys), AS_JSON).alias("key"), *names).select("key.*", *names)


RANK = {"pending": 0, "running": 1, "completed": 2, "failed": 2}
TIMED_OUT = "timed out"


class JobStates(Machine):
    """A job is pending, then running, then completed or failed; pending begins it, nothing leads back, and one that isn't heard of in time has failed."""

    OUT = "status string, at long, notice string"

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def row(self, state, at, n, value):
        if value not in RANK or (value != "pending" if state is None else RANK[value] <= RANK[state[0]]):
            return state, []
        return None if RANK[value] == 2 else (value, at), [(value, at, None)]

    def deadline(self, state):
        return state[1] + self.limit

    def ended(self, state):
        return [("failed", self.deadline(state), TIMED_OUT)]


def micros(interval: str) -> int:
    """Of an interval of days to seconds, as "1 hour"."""
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.timestamp_micros("at"))


def job_states(events: DataFrame, job: str, status: Column, at: str = "ts", n: str = "event_id", limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """job, status, at, notice: every change of a job's state, once, of a stream of events."""
    return timed(run(JobStates(micros(limit)), events, [job], at, n, status, late))


class ResponseCache(Machine):
    """A response is kept for a time from when it was written; a hit doesn't renew it."""

    OUT = "at long, n long, hit boolean"

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def row(self, state, at, n, value):
        return (state, [(at, n, True)]) if state is not None else ((at,), [(at, n, False)])

    def deadline(self, state):
        return state[0] + self.ttl

    def ended(self, state):
        return []


def cache_answers(requests: DataFrame, *keys: str, at: str = "ts", n: str = "event_id", ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """keys, at, n, hit: whether a request of a stream finds a response that was written less than ttl before it."""
    return timed(run(ResponseCache(micros(ttl)), requests, list(keys), at, n, F.lit(None), late))


def cache_answers_batch(requests: DataFrame, *keys: str, at: str = "ts", n: str = "event_id", ttl: str = "1 hour") -> DataFrame:
    """cache_answers() of a table.

    Two writes of a key are ttl apart, so each span of ttl of a key has one at most, and the request that follows a write is
    found in the next span or is the first of a later one: work is divided by key and span. From those the writes are
    reached by following 1, 2, 4, ... of them at once.
    """
    spark, life = requests.sparkSession, micros(ttl)
    rounds = Rounds(spark, "cache")
    rows = requests.select(*keys, F.col(at).cast("timestamp").alias("at"), F.col(n).cast("long").alias("n")).where("at IS NOT NULL")
    rows = rows.withColumn("t", F.unix_micros("at")).withColumn("span", F.floor(F.col("t") / life))
    key = F.struct(*keys)
    times = rounds.kept(rows.select(key.alias("key"), "span", "t").distinct())
    # the next request that finds nothing, if t writes: the first from t + life on
    asked = times.select("key", (F.col("span") + 1).alias("span"), (F.col("t") + life).alias("t"), F.col("t").alias("of"))
    inside = "PARTITION BY key, span ORDER BY t DESC, of IS NULL DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    met = times.select("key", "span", "t", F.lit(None).cast("long").alias("of")).unionByName(asked)
    met = met.withColumn("then", F.expr(f"last_value(CASE WHEN of IS NULL THEN t END) IGNORE NULLS OVER ({inside})")).where("of IS NOT NULL")
    firsts = times.groupBy("key", "span").agg(F.min("t").alias("first"))
    spans = firsts.select("key", "span", "first").unionByName(met.where("then IS NULL").select("key", "span", F.lit(None).cast("long").alias("first")).distinct())
    spans = spans.groupBy("key", "span").agg(F.max("first").alias("first"))
    spans = spans.withColumn("later", F.expr("first_value(first) IGNORE NULLS OVER (PARTITION BY key ORDER BY span ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"))
    follows = met.join(spans.select("key", "span", "later"), ["key", "span"]).select("key", F.col("of").alias("t"), F.coalesce("then", "later").alias("then")).where("then IS NOT NULL")
    ways = rounds.kept(follows)
    written = rounds.kept(times.groupBy("key").agg(F.min("t").alias("t")))
    size = written.count()
    while size:
        more = rounds.kept(written.unionByName(written.join(ways, ["key", "t"]).select("key", F.col("then").alias("t"))).distinct(), written)
        written, before, size = more, size, more.count()
        if size == before:
            break
        ways = rounds.kept(ways.join(ways.select("key", F.col("t").alias("then"), F.col("then").alias("far")), ["key", "then"]).select("key", "t", F.col("far").alias("then")), ways)
    first = F.row_number().over(Window.partitionBy("key", "t").orderBy("n"))
    marked = rows.withColumn("key", key).join(written.select("key", "t", F.lit(True).alias("write")), ["key", "t"], "left")
    # of the requests of one instant the first writes
    out = marked.withColumn("hit", ~(F.coalesce("write", F.lit(False)) & (first == 1))).select(*keys, "at", "n", "hit")
    rounds.ended(written)
    return out


class Answers(Machine):
    """The text of an answer's lines, until [DONE] or until nothing has come for a while; what comes after [DONE] is nothing."""

    OUT = "text string, at long, ended string"

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def row(self, state, at, n, value):
        text, last, done = state or ("", at, False)
        if done or value is None:
            return state, []
        if value == "":
            return (None, at, True), [(text, at, "done")]
        return (text + value[1:], at, False), []

    def deadline(self, state):
        return state[1] + self.idle

    def ended(self, state):
        return [] if state[2] else [(state[0], self.deadline(state), "idle")]


def piece(line: Column) -> Column:
    """Of a line of server-sent events: = and the text it adds, an empty string for [DONE], null for what isn't data."""
    data = F.when(line.startswith("data: "), F.substring(line, 7, F.length(line)))
    return F.when(data == "[DONE]", "").when(data.isNotNull(), F.concat(F.lit("="), F.coalesce(F.get_json_object(data, "$.choices[0].delta.content"), F.lit(""))))


def streamed_answers(lines: DataFrame, answer: str, at: str, n: str = "n", line: str = "line", idle: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """answer, text, at, ended (done or idle) of a stream of lines, as soon as an answer ends. Bad JSON adds nothing."""
    return timed(run(Answers(micros(idle)), lines, [answer], at, n, piece(F.col(line)), late))


def with_rocksdb(spark: SparkSession):
    """The settings that the machines need, for the time in which a stream starts."""
    return settings(spark, ROCKSDB)
