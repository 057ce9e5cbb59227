"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not named and app not in _own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="umbra-")
    return f"{(named or _own[app]).rstrip('/')}/umbra-{tag}-{uuid.uuid4().hex}"


class Rounds:
    """Tables of an iteration in the shared folder: lineage ends at each, and what is no longer needed is deleted."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.at, self.n, self.of = spark, shared_folder(spark, tag), 0, {}

    def kept(self, rows: DataFrame, *instead: DataFrame) -> DataFrame:
        """rows, written and read again; what it was made of may go then."""
        path = f"{self.at}/{self.n}"
        self.n += 1
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.of[id(out)] = (out, path)
        self.dropped(*instead)
        return out

    def alias(self, table: DataFrame, of: DataFrame) -> DataFrame:
        """of, which reads a kept table, is kept and dropped as that one."""
        _, path = self.of.pop(id(table))
        self.of[id(of)] = (of, path)
        return of

    def dropped(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.of.pop(id(t), (None, None))
            if path:
                deleted(self.spark, path)

    def ended(self, *keep: DataFrame) -> None:
        """Drops all but the tables that a result reads."""
        self.dropped(*[t for t, _ in list(self.of.values()) if not any(t is k for k in keep)])


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes a folder where Spark's file systems see it; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class settings:
    """Session settings for a while."""

    def __init__(self, spark: SparkSession, values: dict[str, str]) -> None:
        self.spark, self.values = spark, values

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def without_broadcasts(spark: SparkSession) -> settings:
    """For rounds of joins over growing tables: none of them goes through the driver, however many rounds there are."""
    return settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
