"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id and text. A source whose target is q whole times its size and a rest takes
each document q times, and once more those below a threshold. Word sums by source and hash bucket show the bucket in
which the rest is used up; only that bucket is summed again by its next bits, until it holds one hash value, which is
taken if that comes nearer to the target. No document is sorted, and the same table gives the same mix every time.

Defined cases: null text has no words; a null source is a source of its own, last in order; a document without words
counts as taken q times (and is kept in the mix as often as its source's); equal rows share their fate, and documents of
one hash are taken together or not at all; a source of no words, or one at its cap, has no boundary; a very long text is
one document, so its source may miss the target by half of it; other columns are kept, whatever their names; an empty
table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, made, small, stored, table

HASH_BITS, LEVEL_BITS = 60, 10
#: The table of sources, a row each, is kept on the driver and broadcast; more than these is an error, not a cut.
MOST_SOURCES = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, repeats: float) -> list[float]:
    """Of share * all sizes, by repeating weights; no target is above repeats times its source's size.

    The excess goes to the others by weight until none is above: all that stop do so at one common level.
    """
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    caps = [float(repeats * s) for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / w[i], i))
    left, weight, level = share * sum(sizes), sum(w), 0.0
    for i in order:
        level = left / weight
        if caps[i] / w[i] > level:
            break
        left, weight = left - caps[i], weight - w[i]
    return [min(caps[i], w[i] * level) if caps[i] / w[i] > level else caps[i] for i in range(len(sizes))]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"))


def plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, target, whole, below: a document is taken `whole` times, and once more if its hash is under `below`."""
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    sizes = sorted(((r.source, r.n) for r in sizes), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([n for _, n in sizes], weights, share, repeats)
    whole = [int(t // n) if n else 0 for t, (_, n) in zip(wanted, sizes, strict=True)]
    rest = {s: (t - q * n, 0) for (s, n), t, q in zip(sizes, wanted, whole, strict=True)}  # still to take; the prefix of the boundary bucket
    below: dict[str | None, int] = {s: 0 for s, (left, _) in rest.items() if left <= 0}
    shift, upto = HASH_BITS, Window.partitionBy("s").orderBy("bucket")
    while len(below) < len(sizes):
        shift -= LEVEL_BITS
        open_ = small(spark, [(s, p, float(left)) for s, (left, p) in rest.items() if s not in below], "s string, prefix long, left double")
        at = F.shiftright("hash", shift)
        part = rows.where("size > 0").join(F.broadcast(open_), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        sums = part.groupBy("s", "left", at.alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # the one bucket of a source in which its rest is used up
        found = {r.s: r for r in sums.withColumn("upto", F.sum("n").over(upto)).where("upto > left AND upto - n <= left").select("s", "bucket", "n", "low", "high", "upto").collect()}
        for s in [s for s in rest if s not in below]:
            left, r = rest[s][0], found.get(s)
            if r is None:  # by rounding only: all of it is less than the rest
                below[s] = 1 << HASH_BITS
                continue
            left -= r.upto - r.n
            if r.low == r.high:
                below[s] = r.low + (r.n - left < left)
            else:
                rest[s] = (left, r.bucket)
    return small(spark, [(s, n, float(t), q, below[s]) for (s, n), t, q in zip(sizes, wanted, whole, strict=True)], "source string, source_size long, target double, whole long, below long")


def taken(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (source, hash and any others) with source_size, target and copies; the plan has one row for each source, MOST_SOURCES at most."""
    planned = of.withColumnRenamed("source", "planned_source")
    joined = rows.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("planned_source")))
    return joined.withColumn("copies", F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).drop("planned_source", "whole", "below")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    since = made(docs.sparkSession)
    of = plan(stored(sized(docs), "sizes"), weights, share, repeats)
    dropped(docs.sparkSession, since)
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "source", F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"))
    return taken(rows, of).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(table(spark, sf_dir, "documents")), "sizes")
    return taken(rows, plan(rows)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, n, k, CAST([3, 1, 2][((k - 1) % 3) + 1] AS DOUBLE) AS w, CAST(2 * n AS DOUBLE) AS cap FROM s),
o AS (
  SELECT *, (1.5 * (SELECT CAST(sum(n) AS DOUBLE) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
l AS (SELECT max(level) AS level FROM (SELECT level FROM o WHERE cap / w > level ORDER BY cap / w, k LIMIT 1)),
t AS (
  SELECT source, n, CASE WHEN l.level IS NULL OR cap / w <= l.level THEN cap ELSE w * l.level END AS target FROM w, l),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target / n) AS BIGINT) END AS whole FROM t),
b AS (
  SELECT source, hash, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, hash),
c AS (
  SELECT b.source, b.hash, b.n, sum(b.n) OVER (PARTITION BY b.source ORDER BY b.hash) AS upto, q.target - q.whole * q.n AS rest
  FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
e AS (
  SELECT source, arg_min(CASE WHEN upto - rest < rest - (upto - n) THEN hash + 1 ELSE hash END, hash) AS below
  FROM c WHERE upto > rest GROUP BY source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.n AS source_size, q.target,
       CAST(d.size * (q.whole + CASE WHEN d.hash < coalesce(e.below, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
