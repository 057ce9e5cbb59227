"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of k code points is a closed syncmer if the smallest hash of its inner s-mers is that of its first or last one.
The choice depends on the k-mer alone, so a passage keeps its anchors wherever it stands. A text's fingerprint is the
`size` smallest 32-bit anchor hashes (a bottom sketch), as hex digits; the likeness of two fingerprints is the share of
the smallest hashes of both that both hold, an estimate of the Jaccard likeness of their anchor sets.

Defined cases: a null text counts as empty; an empty text has the fingerprint '' and is like (1.0) empty texts only; a
text without anchor (shorter than k, or by chance) has its own hash as its only anchor; repeated rows, and texts that are
equal, have equal fingerprints; an empty table has none; other columns are kept, whatever their names but `fingerprint`;
a very long text is one row's arrays (some 100 bytes for each code point), so an executor's memory bounds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table

#: With K = S + 7 a k-mer has eight s-mers: three doubling steps give its minimum, and its first and last s-mer hold all its characters.
S, K, SIZE = 9, 16, 128
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS, TIE_BITS = 256, 64, 65536, 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _windowed(h: Column, by: int) -> Column:
    """The smaller of each value and the one `by` further on; at the end there is none, and the value stays."""
    return F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.least(a, b))


def _aligned(text: Column) -> Column:
    """For each code point of a text that is not null the 32-bit hash of the closed syncmer that begins there, else null."""
    smers = F.regexp_extract_all(text, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{S}}}))"), F.lit(1))

    def of(h: Column) -> Column:
        least = _let(_let(_windowed(h, 1), lambda x: _windowed(x, 2)), lambda x: _windowed(x, 4))

        def chosen(m: Column, i: Column) -> Column:
            first, last = F.get(h, i), F.get(h, i + (K - S))
            # null where the text ends before the k-mer does
            return F.when((m == first) | (m == last), first.bitwiseXOR(F.shiftrightunsigned(last, 17)).bitwiseAND(0xFFFFFFFF))

        return F.transform(least, chosen)

    return _let(F.transform(smers, lambda x: F.xxhash64(x)), of)


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>> of a text's closed syncmers; pos counts code points from 0."""
    numbered = F.transform(_aligned(F.coalesce(text, F.lit(""))), lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))
    return F.filter(numbered, lambda x: x["hash"].isNotNull())


def _present(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def _bottom(found: Column, text: Column, size: int) -> Column:
    """The `size` smallest of the anchors found in a text, which stands for itself if there are none."""
    whole = F.array(F.xxhash64(text).bitwiseAND(0xFFFFFFFF))
    least = F.slice(F.sort_array(F.array_distinct(found)), 1, size)
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(_let(least, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))


def sketch(text: Column, size: int = SIZE) -> Column:
    """The `size` smallest anchor hashes of a text that is not null, ascending; array<bigint>."""
    return _bottom(_present(_aligned(text)), text, size)


def sketches(text: Column, keep: Column, edited: Column, size: int = SIZE) -> Column:
    """struct<own, edited>: the sketches of a text and of one that begins with its first `keep` code points.

    An anchor depends on its k-mer alone: those within the common beginning are taken over, and only the rest is read.
    """
    inside = F.greatest(keep - (K - 1), F.lit(0))
    rest = _aligned(F.substring(edited, inside + 1, F.length(edited)))
    both = lambda x: F.concat(_present(F.slice(x, F.lit(1), inside)), _present(rest))
    return _let(_aligned(text), lambda x: F.struct(_bottom(_present(x), text, size).alias("own"), F.when(edited.isNotNull(), _bottom(both(x), edited, size)).alias("edited")))


def as_text(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Of two sketches, 0 to 1; two empty ones are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    share = _let(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share.cast("double"))


def fingerprints(docs: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """docs with `fingerprint`; every other column as it was."""
    return docs.withColumn("fingerprint", as_text(sketch(F.coalesce(F.col(text), F.lit("")), size)))


def places(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, hash, pos: the anchors that a document holds once, and where; what it repeats says nothing about places."""
    found = docs.select("doc_id", F.explode(anchors(F.col(text))).alias("a")).select("doc_id", "a.*")
    return found.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n = 1").drop("n")


def matches(pairs: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """a, b, shift, anchors, first, last of pairs of documents (a, b): positional matching by anchors that both hold once.

    shift is by how many code points b's text lies behind a's where most anchors agree (the smallest of equals), first and
    last are the places in a of the first and last of them. Pairs without a common anchor are left out. doc_id names one
    document; rows of one id are read as one text's anchors.
    """
    at = places(docs.join(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "doc_id", "left_semi"), text)
    left = pairs.select("a", "b").distinct().join(at.select(F.col("doc_id").alias("a"), "hash", F.col("pos").alias("a_pos")), "a")
    both = left.join(at.select(F.col("doc_id").alias("b"), "hash", F.col("pos").alias("b_pos")), ["b", "hash"])
    lines = both.groupBy("a", "b", (F.col("b_pos") - F.col("a_pos")).alias("shift")).agg(F.count("*").alias("anchors"), F.min("a_pos").alias("first"), F.max("a_pos").alias("last"))
    best = lines.groupBy("a", "b").agg(F.max(F.struct("anchors", (-F.col("shift")).alias("by"), "shift", "first", "last")).alias("m"))
    return best.select("a", "b", "m.shift", "m.anchors", "m.first", "m.last")


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most x, looked up in two steps; null: -1."""
    if not bounds:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, math.isqrt(len(bounds)))
    array = lambda xs: F.array(*[F.lit(v) for v in xs]) if len(xs) < 2 else F.expr(f"array({','.join(f'{v}L' for v in xs)})")
    upper = F.size(F.filter(array(bounds[step - 1 :: step]), lambda b: b <= x)) * step
    lower = _let(upper, lambda n: n + F.size(F.filter(F.slice(array(bounds), n + 1, step), lambda b: b <= x)))
    return F.when(x.isNull(), F.lit(-1)).otherwise(lower)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text (null: ''), next_text and the window columns: each document and the next by descending doc_id, after the last the first.

    Documents go to ranges of doc_id of about equal counts; each range also gets the last document of the range before,
    so that no task needs more than its own range. Rows with equal doc_id follow each other by the hash of their text,
    null ids come last; of rows that are equal throughout each is the next of another.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("x")).first().x or []
    # an id at which several shares lie is a range of its own
    bounds = sorted({*found, *(x + 1 for x, y in zip(found, found[1:], strict=False) if x == y)})
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", _bucket(F.col("doc_id"), bounds).cast("long") * F.lit(1 << TIE_BITS))
    # a range of one id (or of null ids) that holds far too many rows is divided by their ties
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hot = {r.bucket: min(1 << TIE_BITS, -(-r.n // ROWS_PER_BUCKET)) for r in sizes.where(F.col("n") > 4 * max(ROWS_PER_BUCKET, n // MOST_BUCKETS)).collect() if not r.ids or (r.ids == r.n and r.low == r.high)}
    if hot:
        share = F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]).cast("map<bigint,bigint>"), F.col("bucket"))
        upper = F.shiftright("tie", 40) + (1 << 23)  # 24 bits, in the order of ties
        rows = rows.withColumn("bucket", F.col("bucket") + F.coalesce(F.shiftright(upper * share, 24), F.lit(0)))
    # one row for each range: MOST_BUCKETS and one for each ROWS_PER_BUCKET rows of an id at most
    last = sorted((r.bucket, r.m.doc_id, r.m.tie) for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("m")).collect())
    if not last:
        return rows.withColumns({"next_text": F.col("text"), "ahead": F.lit(False)})
    edges = [(last[(i + 1) % len(last)][0], doc_id, tie) for i, (_, doc_id, tie) in enumerate(last)]
    ends = small(spark, edges, "to long, edge_id long, edge_tie long")
    ahead = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("tie") == F.col("edge_tie")))
    ahead = ahead.select("doc_id", "text", "tie", F.col("to").alias("bucket"), F.lit(True).alias("ahead")).dropDuplicates(["bucket", "doc_id", "tie"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("ahead", F.lit(False)).unionByName(ahead).repartition(parts, "bucket").withColumn("next_text", F.expr(f"lag(text) OVER ({ORDER})"))


ORDER = "PARTITION BY bucket ORDER BY NOT ahead, doc_id, tie"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    rows = rows.withColumn("keep", n - F.floor(n / 2).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, keep)"), F.expr("substring(next_text, 1, length(text) - keep)"))
    rows = rows.withColumn("edited", F.when(~F.col("ahead"), edited)).withColumn("of", sketches(F.col("text"), F.col("keep"), F.col("edited")))
    rows = rows.select("bucket", "ahead", "doc_id", "tie", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "of")
    rows = rows.withColumn("next_own", F.expr(f"lag(of.own) OVER ({ORDER})")).where(~F.col("ahead"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("of.own")).alias("fingerprint"), as_text(F.col("of.edited")).alias("edited_fingerprint"), likeness(F.col("of.own"), F.col("of.edited")).alias("near_edited"), likeness(F.col("of.own"), F.col("next_own")).alias("near_next"))
