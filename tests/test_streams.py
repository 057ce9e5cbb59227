"""Streams over several batches: what expires, and what comes late."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from umbra.streaming import jobs as S

KIND = "user_id long, event_type string, ts timestamp_ntz, event_id long"


def batches(spark, tmp_path, *rows):
    """A stream that gives each list of rows (user, type, hour) as a batch."""
    n = 0
    for i, part in enumerate(rows):
        made = [(u, t, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), (n := n + 1)) for u, t, h in part]
        (tmp_path / "in").parent.mkdir(exist_ok=True)
        spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
        for f in os.listdir(tmp_path / "in"):  # in order of time
            if f.endswith(".parquet") and os.path.getmtime(tmp_path / "in" / f) > 1e9:
                os.utime(tmp_path / "in" / f, (10_000 * (i + 1),) * 2)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_key_comes_again_after_its_time(spark, tmp_path):
    stream = batches(spark, tmp_path, [(1, "a", 0)], [(1, "a", 0.5), (2, "b", 5)], [(3, "c", 10)], [(1, "a", 11)], [(1, "a", 11.5)])
    got = S.finished(S.first_within(stream, "user_id", "event_type").select("user_id", "event_type", "event_id"), "ttl", "append").orderBy("event_id").collect()
    assert [(r.user_id, r.event_id) for r in got] == [(1, 1), (2, 3), (3, 4), (1, 5)]


def test_late_rows_are_dropped(spark, tmp_path):
    stream = batches(spark, tmp_path, [(1, "a", 0)], [(1, "a", 100)], [(1, "a", 101)], [(1, "a", 1)], [(1, "a", 102)])
    got = S.finished(S.daily_counts(stream), "late", "append").collect()
    assert [(str(r.day), r.jobs) for r in got] == [("2024-01-01", 1)]


def test_states_follow_time_not_arrival(spark, tmp_path):
    stream = batches(spark, tmp_path, [(1, "done", 9)], [(1, "running", 5)])
    got = S.finished(S.latest_states(stream, "user_id"), "states", "complete").collect()
    assert [(r.user_id, r.status) for r in got] == [(1, "done")]


def test_deltas_of_an_answer(spark):
    rows = [(1, 0, 'data: {"choices": [{"delta": {"content": "a"}}]}'), (1, 1, "data: {bad"), (1, 2, 'data: {"choices": [{"delta": {"content": "b"}}]}'), (1, 3, "data: [DONE]"), (1, 4, 'data: {"choices": [{"delta": {"content": "c"}}]}'), (2, 0, ": only a comment")]
    got = S.deltas(spark.createDataFrame(rows, "answer long, n int, line string"), "answer").select("answer", F.col("text")).collect()
    assert [tuple(r) for r in got] == [(1, "ab")]
