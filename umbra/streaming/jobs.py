"""Streams of jobs and answers, as Structured Streaming queries that end when their input does, and logs that streams append to.

Late rows: a row that is older than the watermark is dropped by windowed counts in append mode, by the deduplication and by
the machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.sources.folders import shared_folder
from umbra.streaming.machines import with_rocksdb


def opened(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    # a pattern, so that a table of one file is taken as well as a folder
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(stream: DataFrame, tag: str, mode: str) -> DataFrame:
    """Runs a stream over what there is, and returns its rows; in complete mode those of the last batch."""
    spark = stream.sparkSession
    at = shared_folder(spark, tag)
    with with_rocksdb(spark):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        if mode == "complete":
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).start()
        else:
            query = writer.format("parquet").option("path", f"{at}/rows").start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def daily_counts(events: DataFrame, at: str = "ts", user: str = "user_id", late: str = "1 day") -> DataFrame:
    """Jobs of each user and day (tumbling windows of a day)."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", "1 day").alias("w"), user).agg(F.count("*").alias("jobs")).select(user, F.to_date("w.start").alias("day"), "jobs")


def first_within(events: DataFrame, *keys: str, at: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """One row for each key until the watermark, which is ttl behind, has passed it; machines.cache_answers() counts from the write instead."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", ttl).dropDuplicatesWithinWatermark(list(keys)).drop("_at")


def latest_states(events: DataFrame, by: str, at: str = "ts", tie: str = "event_id", value: str = "event_type") -> DataFrame:
    return events.groupBy(by).agg(F.max_by(value, F.struct(at, tie)).alias("status"))


def deltas(lines: DataFrame, *by: str, line: str = "line", order: str = "n") -> DataFrame:
    """The text of server-sent events by answer, of a table: `data: ` lines up to [DONE] in order; bad JSON adds nothing."""
    data = F.when(F.col(line).startswith("data: "), F.substring(line, 7, F.length(line)))
    rows = lines.select(*by, F.col(order).alias("n"), data.alias("d")).where("d IS NOT NULL")
    content = F.when(F.col("d") == "[DONE]", None).otherwise(F.get_json_object("d", "$.choices[0].delta.content"))
    parts = rows.select(*by, "n", (F.col("d") == "[DONE]").alias("done"), F.coalesce(content, F.lit("")).alias("c")).groupBy(*by).agg(F.collect_list(F.struct("n", "done", "c")).alias("p"))
    end = F.array_min(F.transform(F.filter("p", lambda x: x["done"]), lambda x: x["n"]))
    kept = F.filter(F.array_sort(F.col("p")), lambda x: end.isNull() | (x["n"] < end))
    return parts.select(*by, F.array_join(F.transform(kept, lambda x: x["c"]), "").alias("text"))


def writer_of(state: str) -> str:
    """The name under which a stream with that state folder writes."""
    return hashlib.sha256(state.rstrip("/").encode()).hexdigest()[:16]


def into_log(path: str, state: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch as the log's folder of that stream and batch, over what a run that ended early may have left there."""
    return lambda rows, batch: rows.select("value").write.mode("overwrite").text(f"{path}/batch={writer_of(state)}-{batch:09d}")


def appended_lines(lines: DataFrame, path: str, state: str) -> None:
    """Appends a stream of audit lines (column value) to a log, each once.

    state: the stream's own folder, which the caller names and keeps. It numbers batches, also over runs, and a batch's place
    in the log follows from both; so a second run adds only new lines, and a batch that is repeated after a stop, or replayed
    from a state that was set back, replaces itself. Several streams with states of their own may share a log.
    """
    lines.select("value").writeStream.foreachBatch(into_log(path, state)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
