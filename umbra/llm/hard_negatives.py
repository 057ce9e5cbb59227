"""Hard negatives by a search in order of norms.

Vectors are whole numbers, floor(256 * component); a score is an inner product. Candidates are sorted by norm, longest
first, and dealt into ranges of RANGE rows (MOST_RANGES at most, longer ones then); equal norms are parted by a row
number, so no norm is hot. Anchors are dealt into blocks of BLOCK by hash. A task reads the anchors of a block, then one
range in order of norm, a bucket of BUCKET rows at a time, and holds no more than that. By Cauchy and Schwarz no score in
a bucket is above the anchor's norm times the longest norm of the bucket; an anchor skips the bucket where that is
below the least score that can still count: the lower limit of its windows, or the k-th best score so far if that is
higher. Ranges are searched in rounds (the first, then the next 8, 64, ...), and what a round has found is what
an anchor brings to the next: ranges that can't add anything are left out before anything is shuffled.

The first search gives each anchor's positives, the best rows of its label; each makes a window of scores, and the
second search gives the best rows of other labels in each window. Both are exact: nothing is sampled or cut.

Defined cases: a row with a null label, a null vector, a null or non-finite component, or components so large that scores
might not fit 64 bits (a norm of LONGEST), takes no part; zero and empty vectors do. Vectors of
different lengths have no score. Repeated rows are rows of their own: each other's positives, and anchors each. A null
vec_id is no anchor, comes last in ties and comes out null. A negative positive score has an empty window. An empty
table, or one without anchors, gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, made, stored, table, tidy

RANGE, MOST_RANGES, BLOCK, BUCKET = 8192, 4096, 1024, 2048
#: Of the whole numbers' norms: 90 times a score fits 64 bits.
LONGEST = 3.0e8
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
#: Products of norms below this are exact in double precision.
EXACT = float(1 << 53)
ROWS = "range int, block int, candidate boolean, row long, id long, label int, norm double, v array<long>, windows array<struct<k:int,low:long,high:long,kth:long>>"
FOUND = "row long, k int, id long, score long"


def whole(rows: DataFrame) -> DataFrame:
    """row, id, label, norm and v (whole numbers) of the rows that take part; columns vec_id, label, embedding."""
    limit = F.lit(LONGEST / 128)
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= limit))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("norm", norm).where(F.col("norm") < LONGEST).select(F.monotonically_increasing_id().alias("row"), "id", "label", "norm", "v")


def vectors_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The vectors of a batch, in its order."""
    lists = batch.column("v")
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    return [values[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best: higher scores first, then smaller ids."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in double precision where no sum can be above bound."""
    return a.astype(np.float64) @ b.T.astype(np.float64) if bound < EXACT / 2 else a @ b.T


class Block:
    """The anchors of a block with what they have found in a range."""

    def __init__(self, keep: int, same: bool) -> None:
        self.keep, self.same = keep, same
        self.anchors: list[tuple] = []  # row, label, norm, vector, windows
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, row: int, label: int, norm: float, v: np.ndarray, windows: list[dict]) -> None:
        self.anchors.append((row, label, norm, v, windows))
        self.found.append([(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows])

    def close(self) -> None:
        """No more anchors: those of one length are a matrix; need is the least score of a window that still counts."""
        for dim in {len(a[3]) for a in self.anchors}:
            of = np.array([i for i, a in enumerate(self.anchors) if len(a[3]) == dim])
            self.matrices[dim] = of, np.array([self.anchors[i][3] for i in of], dtype=np.int64).reshape(len(of), dim)
        self.row, self.label = (np.array([a[i] for a in self.anchors], dtype=np.int64) for i in (0, 1))
        self.norm = np.array([a[2] for a in self.anchors])
        self.most = np.array([max(w["high"] for w in a[4]) for a in self.anchors], dtype=np.float64)
        self.need = [[max(w["low"], w["kth"]) for w in a[4]] for a in self.anchors]
        self.least = np.array([min(n) for n in self.need], dtype=np.float64)

    def meet(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, norm: np.ndarray, v: list[np.ndarray]) -> None:
        """A bucket of candidates."""
        lengths = np.array([len(x) for x in v])
        for dim in np.unique(lengths):
            if dim not in self.matrices:
                continue
            some = np.flatnonzero(lengths == dim)
            of, matrix = self.matrices[dim]
            top = norm[some].max()
            live = np.flatnonzero(self.norm[of] * top * (1 + 1e-9) + 1 >= self.least[of])
            if not len(live):
                continue
            scores = products(matrix[live], np.array([v[i] for i in some], dtype=np.int64).reshape(len(some), dim), self.norm[of[live]].max() * top)
            fits = label[some] == self.label[of[live], None]
            fits = fits & (row[some] != self.row[of[live], None]) if self.same else ~fits
            fits &= (scores >= self.least[of[live], None]) & (scores <= self.most[of[live], None])
            for i in np.flatnonzero(fits.any(axis=1)):
                hit = np.flatnonzero(fits[i])
                self._take(of[live[i]], scores[i, hit].astype(np.int64), ids[some[hit]])

    def _take(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates whose label fits, into the windows of an anchor."""
        for n, w in enumerate(self.anchors[at][4]):
            hit = (scores >= self.need[at][n]) & (scores <= w["high"])
            if not hit.any():
                continue
            s, i = (np.concatenate(x) for x in zip(self.found[at][n], (scores[hit], ids[hit]), strict=True))
            kept = best(s, i, self.keep)
            self.found[at][n] = s[kept], i[kept]
            if len(kept) == self.keep:
                self.need[at][n] = max(self.need[at][n], int(s[kept[-1]]))
        self.least[at] = min(self.need[at])

    def rows(self) -> pa.RecordBatch:
        out = [(a[0], w["k"], i, s) for a, found in zip(self.anchors, self.found, strict=True) for w, (scores, ids) in zip(a[4], found, strict=True) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 1 else pa.int64()) for i in range(4)], names=["row", "k", "id", "score"])


def _kernel(keep: int, same: bool):
    """Rows (ROWS) sorted by range, block, anchors first, norm: the best of each window in each range (FOUND)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, open_ = None, None, False
        for whole_batch in batches:
            keys = np.stack([whole_batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("range", "block", "candidate")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                key, candidates = tuple(keys[a, :2]), bool(keys[a, 2])
                if key != at:
                    if block is not None:
                        yield block.rows()
                    at, block, open_ = key, Block(keep, same), True
                for b in range(a, z, BUCKET):
                    part = whole_batch.slice(b, min(BUCKET, z - b))
                    row, label, norm, v = (part.column("row").to_numpy(), part.column("label").to_numpy(), part.column("norm").to_numpy(), vectors_of(part))
                    if not candidates:
                        for r, lab, x, y, w in zip(row.tolist(), label.tolist(), norm.tolist(), v, part.column("windows").to_pylist(), strict=True):
                            block.add(r, lab, x, y, w)
                        continue
                    if open_:
                        block.close()
                        open_ = False
                    block.meet(row, part.column("id").to_numpy(), label, norm, v)
        if block is not None:
            yield block.rows()

    return run


def search(anchors: DataFrame, ranged: DataFrame, tops: list[float], keep: int, same: bool) -> DataFrame:
    """row, k, id, score: of each window of an anchor (row, label, norm, v, windows of k, low, high) the `keep` best candidates.

    ranged: candidates (range, row, id, label, norm, v); tops: the longest norm of each range, longest first. same: of the
    anchor's label, and not the anchor itself; otherwise of other labels.
    """
    spark, since = ranged.sparkSession, made(ranged.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    found, first, step = None, 0, 1
    while first < len(tops):
        asked, kth = anchors, lambda k: F.lit(LEAST)
        if found is not None:  # the k-th best so far, of a few windows for each anchor
            full = found.groupBy("row", "k").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= keep)
            full = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "kth"))).alias("full"))
            asked, kth = anchors.join(full, "row", "left"), lambda k: F.coalesce(F.try_element_at("full", k), F.lit(LEAST))
        asked = asked.withColumn("windows", F.transform("windows", lambda w: F.struct(w["k"].alias("k"), w["low"].alias("low"), w["high"].alias("high"), kth(w["k"]).alias("kth"))))
        need = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["kth"])))
        span = tops[first : first + step]
        long_enough = lambda r: F.col("norm") * F.element_at(F.array(*[F.lit(t) for t in span]), r - first + 1) * (1 + 1e-9) + 1 >= need
        pairs = asked.select(F.explode(F.filter(F.sequence(F.lit(first), F.lit(first + len(span) - 1)), long_enough)).alias("range"), "block", F.lit(False).alias("candidate"), "row", F.lit(NO_ID).alias("id"), "label", "norm", "v", "windows")
        pairs = stored(pairs, "pairs")
        met = pairs.select(F.col("range").alias("r"), "block").distinct()
        rows = ranged.where(F.col("range").between(first, first + len(span) - 1)).join(met, F.col("range") == F.col("r"))
        rows = rows.select("range", "block", F.lit(True).alias("candidate"), "row", "id", "label", "norm", "v", F.lit(None).cast("array<struct<k:int,low:long,high:long,kth:long>>").alias("windows"))
        dealt = pairs.unionByName(rows).repartition(parts, "range", "block").sortWithinPartitions("range", "block", "candidate", F.desc("norm"), "row")
        new = dealt.mapInArrow(tidy(_kernel(keep, same)), FOUND)
        order = "ORDER BY score DESC, id"
        new = (new if found is None else new.unionByName(found)).withColumn("place", F.expr(f"row_number() OVER (PARTITION BY row, k {order})")).where(F.col("place") <= keep).drop("place")
        found = stored(new, "found")
        dropped(spark, since, found)
        first, step = first + len(span), 8 * step
    return found


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding; anchor: which rows (by vec_id) are anchors; low and high: percent of the positive's
    score that a negative's may have.
    """
    spark, since = rows.sparkSession, made(rows.sparkSession)
    empty = spark.createDataFrame(pa.table({n: pa.array([], pa.int32() if n == "rank" else pa.int64()) for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")}))
    vectors = stored(whole(rows), "vectors")
    anchors = vectors.withColumn("vec_id", F.col("id")).where(F.col("id").isNotNull() & anchor).drop("vec_id")
    count = vectors.count()
    if not count or anchors.isEmpty():
        dropped(spark, since)
        return empty
    vectors = vectors.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    ranges = min(MOST_RANGES, -(-count // RANGE))
    ranged = stored(vectors.repartitionByRange(ranges, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row").select(F.spark_partition_id().alias("range"), "*"), "ranged")
    longest = {r.range: r.top for r in ranged.groupBy("range").agg(F.max("norm").alias("top")).collect()}  # a row for each range
    tops = [longest.get(r, 0.0) for r in range(max(longest) + 1)]
    window = lambda k, low, high: F.struct(k.cast("int").alias("k"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    every = F.array(window(F.lit(0), F.lit(LEAST), F.lit(NO_ID)))
    near = search(anchors.select("row", "label", "norm", "v", every.alias("windows")), ranged, tops, positives, same=True)
    numbered = near.select("row", F.expr("row_number() OVER (PARTITION BY row ORDER BY score DESC, id) - 1").alias("k"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    numbered = stored(numbered.where("positive_score >= 0"), "positives")
    # low * p <= 100 * n <= high * p in whole numbers
    least, most = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"({high} * positive_score) div 100")
    wanted = numbered.groupBy("row").agg(F.collect_list(window(F.col("k"), least, most)).alias("windows"))
    hard = search(anchors.join(wanted, "row").select("row", "label", "norm", "v", "windows"), ranged, tops, negatives, same=False)
    if hard is None:
        return empty
    rank = F.expr("row_number() OVER (PARTITION BY row, k ORDER BY score DESC, id)")
    ranked = hard.select("row", "k", rank.alias("rank"), F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast("long")
    out = anchors.select("row", F.col("id").alias("anchor_id")).join(numbered, "row").join(ranked, ["row", "k"])
    out = stored(out.select("anchor_id", named("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative").alias("negative_id"), "positive_score", "negative_score"), "hard")
    dropped(spark, since, out)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id,
         p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
