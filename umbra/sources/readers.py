"""Sources and sinks: tables, source trees, archives, audit logs, and the rule for what of a file may be shown."""

from __future__ import annotations

import fnmatch
import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.abstraction import EXTENSIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows may lie in fewer tasks than there are cores dealt out; others as they are.

    A file's row group is read by one task, however many splits the file has, so few files count as well as few splits.
    Files are listed only where there are few splits, each of which holds a bounded number of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores or (splits < 32 * cores and len(df.inputFiles()) < cores) else df


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression; * crosses slashes."""
    return re.sub(r"\\Z$|\\z$", "", fnmatch.translate(pattern)).removesuffix(")").replace("(?s:", "(?s)", 1) + r"\z"


def discovered(paths: DataFrame, root: str, include: list[str] | None = None, exclude: list[str] | None = None, path: str = "path") -> DataFrame:
    """The paths below root that a pattern includes, none excludes, and whose extension is known; with language."""
    rel = F.regexp_replace(F.col(path), "^" + re.escape(root.rstrip("/")) + "/", "")

    def any_of(patterns: list[str]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | rel.rlike("^" + glob_regex(p)) | F.col(path).rlike("^" + glob_regex(p))
        return hit

    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return paths.where(any_of(include or ["**/*"]) & ~any_of(exclude or [])).withColumn("language", F.try_element_at(names, ext)).where("language IS NOT NULL")


def source_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """path, content, language of the code files below a folder, read as whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    found = discovered(files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content"), root, include, exclude)
    return found.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.lit("# ERROR: failed to read file: not UTF-8\n")).alias("content"), "language")


def unzipped(archives: DataFrame, content: str = "content") -> DataFrame:
    """archive, path, content: the text files of zip archives (columns path and a binary one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["data"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows = [(name, i.filename, z.read(i).decode("utf-8", "ignore")) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, TypeError):
                    pass
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return archives.select("path", F.col(content).alias("data")).mapInPandas(run, "archive string, path string, content string")


#: What is passed on as bytes, and of what only the header is shown.
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "pdf"]
DATASET = ["csv", "tsv", "sql", "db", "sqlite", "parquet"]


def shown(path: Column, content: Column) -> Column:
    """struct<kind, body> of a file (binary content): base64 of binary ones, the first line of datasets, else the text."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    text = content.cast("string")
    fine = F.is_valid_utf8(text)
    header = F.trim(F.substring_index(text, "\n", 1))
    return (
        F.when(ext.isin(BINARY), F.struct(F.lit("binary").alias("kind"), F.base64(content).alias("body")))
        .when(ext.isin(DATASET) & fine, F.struct(F.lit("schema").alias("kind"), header.alias("body")))
        .when(ext.isin(DATASET) | ~fine, F.struct(F.lit("blocked").alias("kind"), F.lit(None).cast("string").alias("body")))
        .otherwise(F.struct(F.lit("text").alias("kind"), text.alias("body")))
    )


def audit_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """ts, action, details of `[time] ACTION | details` lines; others are dropped."""
    of = lambda i: F.regexp_extract(line, r"^\[([^\]]+)\] ([^|]*?) \| (.*)$", i)
    return lines.select(F.try_to_timestamp(of(1)).alias("ts"), of(2).alias("action"), of(3).alias("details")).where("action != ''")


def audit_line(ts: Column, action: Column, details: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("] "), action, F.lit(" | "), details)


def append_audit(lines: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends lines (column value) to a log, as its folder of that batch: a name given again replaces what it wrote before."""
    name = batch or f"one-{uuid.uuid4().hex}"
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"{name!r} can't be the name of a batch")
    lines.select("value").write.mode("overwrite").text(f"{path}/batch={name}")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """value, batch: the lines of a log."""
    return spark.read.option("basePath", path).schema("value string, batch string").text(f"{path}/batch=*")
