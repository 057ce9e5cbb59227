"""State machines over several batches, and logs over several runs: late, repeated and unordered rows, stops and replays."""

import datetime as dt
import os
import random
import shutil

from pyspark.sql import functions as F
from test_streams import batches

from umbra.sources import readers as R
from umbra.streaming import jobs as S
from umbra.streaming import machines as M

HOUR = 3_600_000_000
T0 = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp()) * 1_000_000


def folded(machine, rows, until):
    """By key: the machine over all rows before `until` in order, and what has ended by then; rows (key, value, hour, n)."""
    out = []
    for key in sorted({r[0] for r in rows}):
        state = None
        for _, v, h, n in sorted((r for r in rows if r[0] == key and r[2] < until), key=lambda r: (r[2], r[3])):
            state, more = machine.step(state, T0 + round(h * HOUR), n, v)
            out += [(key, *x) for x in more]
        if state is not None and machine.deadline(state) <= T0 + round(until * HOUR):
            out += [(key, *x) for x in machine.ended(state)]
    return sorted(out, key=repr)


def micros(df, *names):
    return sorted((tuple(r) for r in df.withColumn("at", F.unix_micros("at")).select(*names).collect()), key=repr)


def test_job_states_over_batches(spark, tmp_path):
    parts = [
        [(1, "pending", 0), (2, "pending", 0), (3, "running", 0), (4, "pending", 0)],
        [(1, "completed", 2), (1, "running", 1), (1, "pending", 1.5), (2, "failed", 1), (2, "completed", 1.2)],  # unordered, repeated, backward, after the end
        [(1, "pending", 3), (4, "running", 9)],  # a new life; in time no more
        [(1, "running", 2.5), (5, "pending", 9)],  # later than the watermark: dropped
        [(6, "pending", 30)],
    ]
    stream = batches(spark, tmp_path, *parts)
    got = S.finished(M.job_states(stream, "user_id", F.col("event_type"), limit="5 hours", late="3 hours"), "states", "append")
    want = [(1, "pending", 0, None), (1, "running", 1, None), (1, "completed", 2, None), (1, "pending", 3, None), (1, "failed", 8, M.TIMED_OUT), (2, "pending", 0, None), (2, "failed", 1, None), (4, "pending", 0, None), (4, "failed", 5, M.TIMED_OUT), (5, "pending", 9, None), (5, "failed", 14, M.TIMED_OUT)]
    assert micros(got, "user_id", "status", "at", "notice") == sorted([(k, s, T0 + h * HOUR, x) for k, s, h, x in want], key=repr)


def test_machines_are_as_their_fold(spark, tmp_path):
    """Random rows of many batches, each batch up to two hours out of order."""
    r = random.Random(4)
    rows = sorted(((r.randrange(8), r.choice(["pending", "running", "completed", "failed", "noise"]), r.randrange(4000) / 40, 0) for _ in range(500)), key=lambda x: x[2] + 2 * r.random())
    parts = [[x[:3] for x in rows[i : i + 100]] for i in range(0, 500, 100)]
    numbered = [(*x[:3], i + 1) for i, x in enumerate(rows)]
    until = max(x[2] for x in rows) - 3
    states = S.finished(M.job_states(batches(spark, tmp_path / "a", *parts), "user_id", F.col("event_type"), limit="5 hours", late="3 hours"), "states", "append")
    assert micros(states, "user_id", "status", "at", "notice") == folded(M.JobStates(5 * HOUR), numbered, until)
    asked = S.finished(M.cache_answers(batches(spark, tmp_path / "b", *parts), "user_id", ttl="4 hours", late="3 hours"), "cache", "append")
    stream = micros(asked, "user_id", "at", "n", "hit")
    assert stream == folded(M.ResponseCache(4 * HOUR), numbered, until)
    table = spark.read.parquet(str(tmp_path / "b" / "in"))
    assert [x for x in micros(M.cache_answers_batch(table, "user_id", ttl="4 hours"), "user_id", "at", "n", "hit") if x[1] < T0 + round(until * HOUR)] == stream


def test_a_hit_does_not_renew(spark):
    at = [0, 0.5, 0.9, 1.0, 1.5, 2.0, 2.0, 7.2, 8.1, 8.3]
    rows = [(1, "a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i) for i, h in enumerate(at)] + [(2, None, dt.datetime(2024, 1, 1), 99), (2, None, None, 100)]
    got = M.cache_answers_batch(spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, event_id long"), "user_id", "event_type").orderBy("n").collect()
    assert [r.hit for r in got] == [False, True, True, False, True, False, True, False, True, False, False]
    assert M.cache_answers_batch(spark.createDataFrame([], "user_id long, ts timestamp, event_id long"), "user_id").count() == 0


def test_answers_end(spark, tmp_path):
    line = lambda t: 'data: {"choices": [{"delta": {"content": "' + t + '"}}]}'
    parts = [[(1, line("a"), 0), (2, line("x"), 0), (3, ": note", 0)], [(1, line("c"), 0.4), (1, line("b"), 0.2), (2, "data: {bad", 0.1)], [(1, "data: [DONE]", 0.5), (1, line("late"), 0.6)], [(4, line("y"), 9)], [(5, line("z"), 30)]]
    got = S.finished(M.streamed_answers(batches(spark, tmp_path, *parts), "user_id", "ts", n="event_id", line="event_type", idle="1 hour", late="30 minutes"), "answers", "append")
    assert micros(got, "user_id", "text", "ended", "at") == [(1, "abc", "done", T0 + HOUR // 2), (2, "x", "idle", T0 + HOUR // 10 + HOUR), (4, "y", "idle", T0 + 10 * HOUR)]


def log_of(spark, path):
    return sorted(r.value for r in R.audit_log(spark, path).collect())


def put(spark, folder, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)


def test_a_log_over_runs_stops_and_replays(spark, tmp_path):
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    lines = lambda: spark.readStream.text(source)
    put(spark, source, "one")
    S.appended_lines(lines(), log, state)
    assert log_of(spark, log) == ["one"]
    put(spark, source, "two", "two")
    S.appended_lines(lines(), log, state)
    S.appended_lines(lines(), log, state)
    assert log_of(spark, log) == ["one", "two", "two"]
    # a stop after the second batch was written, before it was committed; part of it was written
    for name in os.listdir(f"{state}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{state}/commits/{name}")
    folder = next(f"{log}/{d}" for d in os.listdir(log) if d.endswith("-000000001"))
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    put(spark, folder, "half of")
    S.appended_lines(lines(), log, state)
    assert log_of(spark, log) == ["one", "two", "two"]
    # a replay of everything from a state that was set back
    for name in os.listdir(f"{state}/commits"):
        os.remove(f"{state}/commits/{name}")
    for name in os.listdir(f"{state}/offsets"):
        if not name.strip(".").startswith("0"):
            os.remove(f"{state}/offsets/{name}")
    S.appended_lines(lines(), log, state)
    assert log_of(spark, log) == ["one", "two", "two"]
    # another stream shares the log
    put(spark, str(tmp_path / "other"), "three")
    S.appended_lines(spark.readStream.text(str(tmp_path / "other")), log, str(tmp_path / "state2"))
    R.append_audit(spark.createDataFrame([("four",)], "value string"), log, "job-1")
    assert log_of(spark, log) == ["four", "one", "three", "two", "two"]
    shutil.rmtree(state)


def test_many_keys_are_few_groups(spark, tmp_path, monkeypatch):
    """Keys share buckets, so calls to the state store don't grow with them; keys of several types, also null, come back as they were."""
    monkeypatch.setattr(M, "BUCKETS", 2)
    rows = [(i if i else None, f"\"{i % 3}\\", T0 / 1e6 + (i * 7 % 50) * 60 + k * 7200, 100 * i + k) for i in range(40) for k in range(3)] + [(-1, "x", T0 / 1e6 + 90_000, 9999)]
    spark.createDataFrame(rows, "a long, b string, s double, n long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b string, s double, n long, ts timestamp").parquet(str(tmp_path / "in"))
    out = M.cache_answers(stream, "a", "b", n="n", ttl="3 hours", late="10 minutes")
    groups = [p for p in str(out._jdf.queryExecution().analyzed()).split("\n") if "bucket" in p]
    assert groups
    got = S.finished(out, "cache", "append")
    assert sorted(((r.a, r.b, r.n, r.hit) for r in got.collect()), key=repr) == sorted(((a, b, n, n % 100 == 1) for a, b, _, n in rows[:-1]), key=repr)
