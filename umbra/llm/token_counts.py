"""Token counts through a cache of digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by that of its file, its library's release and its
kind. Texts that a tokenizer can't tell apart have one content: for the sentencepiece model, whose own normalisation is
the identity but for white space, U+2581 is a space. The cache is a Parquet folder of digests and counts below a folder
of its tokenizer's digest. What it lacks is encoded, each text once, by the tokenizer's own library, and appended: each run
writes a folder of its own, so a run that ends early or runs beside another leaves rows that are right by themselves,
and a reader takes one row of a digest. Counts come to the documents by a join on the digest.

Copies meet as partial aggregates before any shuffle, so that a text that fills a third of the table goes once from each
task. Where few digests are missing beside others that aren't (FEW, 32 bytes each), only their texts are shuffled; otherwise all
are, and the join with the missing digests follows on the same exchange. Both ways give the same rows.

Defined cases: a null text is an empty one and has no tokens; white space counts as the library has it; equal rows, and
null and equal ids, are counted each for itself; a very long text is encoded whole, by one call; an empty table gives no
rows and leaves the cache as it was; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, made, new_folder, stored, table, tidy

LIMIT, FEW = 4096, 100_000
CACHED = "digest binary, n_tokens long"


def place(name: str) -> str:
    """The path of a public tokenizer's file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version(name: str) -> str:
    """The digest of a tokenizer: its file, and the release of the library that reads it."""
    import sentencepiece
    import tokenizers

    kind = f"sentencepiece {sentencepiece.__version__}" if name.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(place(name), "rb") as f:
        return hashlib.sha256(kind.encode() + b"\n" + hashlib.file_digest(f, "sha256").digest()).hexdigest()


def counter(name: str) -> Callable[[str], int]:
    """Tokens of a text as the tokenizer's library gives them, nothing added."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=place(name))
        return lambda text: len(model.encode(text, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(place(name))
    whole.no_truncation()
    whole.no_padding()
    return lambda text: len(whole.encode(text, add_special_tokens=False))


@functools.cache
def escapes(name: str) -> bool:
    """Whether a model takes U+2581 for a space and changes nothing else, so that both are one content."""
    if not name.endswith(".model"):
        return False
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=place(name))
    odd = "  a▁  　ﬁ́\t\nＡ  "
    return model.normalize(odd).lstrip("▁") == odd.replace(" ", "▁").lstrip("▁") and model.normalize(odd) == model.normalize(odd.replace("▁", " "))


def content(text: Column, name: str) -> Column:
    """The normalised content."""
    text = F.coalesce(text, F.lit(""))
    return F.translate(text, "▁", " ") if escapes(name) else text


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(name)
            texts = batch.column("content")
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([count(texts[i].as_py()) for i in range(len(texts))], pa.int64())], names=["digest", "n_tokens"])

    return run


def cached(spark: SparkSession, cache: str, name: str) -> DataFrame:
    """digest, n_tokens of what the cache holds for a tokenizer, a row each; no cache is an empty one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/{version(name)}/*")
    if not any(x.isDirectory() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []):
        return spark.createDataFrame(pa.table({"digest": pa.array([], pa.binary()), "n_tokens": pa.array([], pa.int64())}))
    rows = spark.read.schema(CACHED).parquet(f"{cache}/{version(name)}/*")
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, cache: str, name: str = "piece_bpe_32k.model", few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; cache: a folder that lasts, which this run's misses are appended to."""
    spark, since = docs.sparkSession, made(docs.sparkSession)
    texts = docs.select(content(F.col("text"), name).alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(content(F.col("text"), name).cast("binary"), 256)).alias("digest"))
    keyed = stored(keyed, "keyed")
    known = cached(spark, cache, name)
    wanted = stored(keyed.select("digest").distinct().join(known, "digest", "left"), "wanted")
    hits, misses = wanted.where("n_tokens IS NOT NULL"), wanted.where("n_tokens IS NULL").select("digest")
    missing, present = misses.count(), not hits.isEmpty()
    if not missing:
        return _joined(keyed, hits)
    if present and missing <= few:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    distinct = texts.groupBy("digest").agg(F.first("content").alias("content"))
    if present and missing > few:
        distinct = distinct.join(misses, "digest", "left_semi")
    batch = f"{cache}/{version(name)}/{uuid.uuid4().hex}"
    distinct.select("digest", "content").mapInArrow(tidy(_encode(name)), CACHED).write.parquet(batch)
    counts = stored(hits.unionByName(spark.read.schema(CACHED).parquet(batch)), "counts")
    dropped(spark, since, keyed, counts)
    return _joined(keyed, counts)


def _joined(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run encodes every distinct text."""
    rows = counted(table(spark, sf_dir, "documents"), new_folder(spark, "token-cache"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
