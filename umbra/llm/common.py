"""What the operators share: tables, folders that all executors see, word rules and folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import threading
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from umbra.sources.folders import shared_folder

#: ASCII white space separates words; every other character belongs to one.
WORD = "[^\\x20\\x09-\\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Whole texts go to Python workers so many rows, or bytes, at a time, not 10,000 rows: memory follows the longest text.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("64MB", "4m")}


def ready(spark: SparkSession) -> None:
    """Small batches, where the session still has Spark's own, and a place where workers find this package if it isn't installed."""
    for name, (usual, small_) in BATCHES.items():
        if spark.conf.get(name, usual).lower() in (usual.lower(), "67108864b", "67108864"):
            spark.conf.set(name, small_)
    home, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), home) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_FILE = 50_000

#: The folders that stored() has made and that haven't been dropped; each thread of an application has its own.
_made: dict[tuple[str, int], list[str]] = {}


def _mine(spark: SparkSession) -> list[str]:
    return _made.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def new_folder(spark: SparkSession, tag: str) -> str:
    """In the shared folder; off local mode spark.checkpoint.dir must name it."""
    return shared_folder(spark, tag)


def stored(df: DataFrame, tag: str, few: bool = False, rows: int | None = None, gathered: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there.

    few: it is small beside the input (some dozen bytes a document) and cheap to make, and goes to an eighth as many files
    as a shuffle has partitions. rows: about so many, known beforehand: it goes to a file for each ROWS_PER_FILE, two at
    least. gathered: it is small but dear to make: it is made in all tasks and then shuffled to as few files.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(2, min(parts, -(-rows // ROWS_PER_FILE)) if rows is not None else parts // 8)
    if gathered:
        df = df.repartition(files)
    elif few or rows is not None:
        df = df.coalesce(files)
    df.write.parquet(path)
    _mine(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def made(spark: SparkSession) -> int:
    """How many tables are stored by now, for dropped()."""
    return len(_mine(spark))


def dropped(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Deletes what was stored since then but for the tables of keep: for steps whose result needs them no more."""
    paths, kept = _mine(spark), {x.stored_at for x in keep}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [x for x in paths[since:] if x not in kept]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        paths.remove(path)


def release() -> None:
    """Gives memory that is free again back to the system: a worker waits for its next task with little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, then release()."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a bounded list that the driver holds; by Arrow, so that no Python worker takes part."""
    of = to_arrow_schema(T._parse_datatype_string(schema))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(of)
    return spark.createDataFrame(pa.table([pa.array(c, type=f.type) for c, f in zip(columns, of, strict=True)], schema=of))


def mounted(uri: str) -> str:
    """The path at which driver and executors open files of the shared folder."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: files that workers map into memory need a shared folder that is mounted (file:)")
    return unquote(parts.path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """The WORDs of a text in UTF-8, A-Z lower-cased; bytes.split() parts at the same ASCII white space."""
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
