"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A listed URL is a host and the beginning of a path; it fits its host and all subdomains if the path starts so. Every
distinct url has few candidates: the ends of its host by labels, each with the beginnings of its path at the lengths
that are listed. The filter (64-byte blocks, one bit in each of eight words a key) drops nearly all that aren't
listed; the hash join with the list itself removes the false positives. The filter has at most MOST_BLOCKS rows (16 MiB, eleven million keys)
however long the list is, so it is broadcast; a longer list only lets more candidates through to the join.

Defined cases: a null url or one without `://` has an empty host and path and fits nothing; listed rows with a null
host or path, or an empty host, fit nothing; of a key listed twice `allow` counts; the longest key wins, then the longer
host; what fits nothing has the verdict `otherwise`; repeated urls are judged once, repeated rows are kept; without pages
there is no row, without a list every page has the verdict `otherwise`; a very long url has one candidate for each end of
its host and each listed length of a path; other columns are kept, whatever their names but host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small, table

WORDS, BITS_PER_KEY, BLOCK_BITS, MOST_BLOCKS = 8, 12, 512, 1 << 18


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(key_hash, F.lit(blocks))


def _mask(key_hash: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key_hash, F.lit(word)), F.lit(64)).cast("int"))


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of n keys (column key): block, w0 to w7; and its number of blocks."""
    blocks = min(MOST_BLOCKS, max(1, n * BITS_PER_KEY // BLOCK_BITS + 1))
    h = keys.select(F.xxhash64("key").alias("h"))
    return h.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*[F.bit_or(_mask(F.col("h"), w)).alias(f"w{w}") for w in range(WORDS)]), blocks


def marked(candidates: DataFrame, of: DataFrame, blocks: int) -> DataFrame:
    """The candidates (column key; null is in no filter) with `may`: whether the filter lets them through."""
    h = F.xxhash64("key")
    hit = F.col("key").isNotNull() & F.col("w0").isNotNull()
    for w in range(WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_mask(h, w)) != 0)
    joined = candidates.join(F.broadcast(of), _block(h, blocks) == F.col("block"), "left")
    return joined.select(*candidates.columns, F.coalesce(hit, F.lit(False)).alias("may"))


def decide(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; listed: host, path, verdict (allow or block)."""
    rules = listed.where("host != '' AND path IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    rules = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.length("host")).alias("host_length"), F.min("verdict").alias("verdict"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.max(F.length("path")).alias("path_length"))
    known = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path")).where("host != ''")
    if known.n:
        ends = F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", "\\.")), F.lit(known.labels))))
        lengths = F.array(*[F.lit(x) for x in sorted(known.lengths)])
        candidates = urls.select("url", "path", "host", ends.alias("ends")).select("url", "path", F.expr("substring_index(host, '.', -ends)").alias("end"), F.explode(F.filter(lengths, lambda x: x <= F.length("path"))).alias("cut"))
        candidates = candidates.select("url", F.concat("end", F.expr("left(path, cut)")).alias("key"))
        found = marked(candidates, *bloom(rules.select("key"), known.n)).where("may").drop("may").join(rules.select("key", "host_length", "verdict"), "key")
        best = found.groupBy("url").agg(F.max(F.struct(F.length("key").alias("length"), "host_length", "key", "verdict")).alias("best"))
    else:
        best = urls.select("url", F.lit(None).cast("struct<length:int,host_length:int,key:string,verdict:string>").alias("best")).limit(0)
    # a page is carried in a struct, so that its columns clash with nothing
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    joined = rows.join(best.select(F.col("url").alias("judged_url"), "best"), F.col("page.url") == F.col("judged_url"), "left")
    host, path = host_and_path(F.col("page.url"))
    kept = [F.col(f"page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return joined.select(*kept, host.alias("host"), path.alias("path"), F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = small(spark, RULES, "host string, path string, verdict string")
    return decide(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
d AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
