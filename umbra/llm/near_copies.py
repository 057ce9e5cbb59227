"""Near copies of whole texts: SimHash fingerprints in BK-trees, verified by the likeness of their word shingles.

Texts at a likeness of 0.8 differ in ten fingerprint bits or so and up to RADIUS, too many for shards by equal bits. A
shard here is the texts with one min-hash of their distinct shingles; two such texts share one of HASHES with near
certainty (1 - 0.2^8). A shard holds fingerprints and sets of shingle hashes (32 bits each). Its BK-tree is searched
within RADIUS bits, of what it finds the nearest come first, and texts that aren't joined yet are joined if their whole
sets are as alike as asked. A shard returns the joins that it made, not pairs: no more than it has texts. Copies (equal
words) are one text throughout.

A shard of over SHARD shingles (one copied or templated text a thousand times) is dealt out by a hash first, which joins
most of a large group. Then its texts meet again by each of HASHES further min-hashes, where more than one root is left;
what stays over SHARD is compared in all blocks, but for those within its largest group, which is joined already. So
every two texts of a shard within the radius that aren't joined by others are compared, whatever lies nearer to them.
Rows grow faster than the input only for a group over SHARD of which most are neither joined nor parted by the further
min-hashes: texts that share some 60 to 80 % of their shingles.

What can be lost: a pair at a likeness of just 0.8 shares no min-hash (3 in a million) or, in a large shard, none of the
further ones (the same), or lies beyond RADIUS = 26 of 64 bits (one in a million; of five shingles against four 3).

Defined cases: null and empty texts are copies of each other; fewer words than a shingle needs are one shingle; repeated
rows are one; a null id counts as the smallest; an empty table stays empty; other columns, whatever their names, don't
matter and are kept; a very long text is one set of its distinct shingles, four bytes each, and may fill a block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, made, stored, tidy, words
from .components import components
from .passages import _mix, shingles, split, word_hashes
from .simhash import BKTree

#: SHARD: shingles that meet in one task at once.
SHINGLE, SIMILARITY, HASHES, RADIUS, SHARD = 5, 0.8, 8, 26, 1 << 18
SEEDS = np.array([xxhash.xxh64_intdigest(b"copies", seed=i) for i in range(2 * HASHES)], dtype=np.uint64)

def grams(text: str | None, k: int) -> np.ndarray:
    """The hash of each shingle; of all words if there are fewer; none without words."""
    found = shingles(text, k)
    if len(found):
        return found
    w = word_hashes(text)
    return shingles(text, len(w)) if len(w) else w


def _bits(h: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def _described(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                h = np.unique(grams(text, k))
                least = [int(_mix(h ^ s).min().view(np.int64)) for s in SEEDS] if len(h) else []
                d = xxhash.xxh128_intdigest(b" ".join(words(text)))
                out.append((*(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & (1 << 64) - 1)), _bits(h) if len(h) else 0, least, len(h), (h >> np.uint64(32)).astype("<u4").tobytes()))
            rows = pd.DataFrame(out, columns=["d1", "d2", "fp", "least", "n", "grams"])
            yield pd.DataFrame({"node": b["node"].to_numpy(), "doc_id": b["doc_id"].astype("Int64"), **{c: rows[c].to_numpy() for c in rows}})

    return run


class Tree:
    """A BK-tree of distinct fingerprints as arrays: a search looks at all nodes of a level that edges can lead to at once."""

    def __init__(self, values: np.ndarray) -> None:
        tree = BKTree()
        for x in values.tolist():
            tree.add(x)
        self.tree, self.values = tree, values
        self.count = np.array([len(c) for c in tree.children])
        self.first = np.cumsum(self.count) - self.count
        self.edge = np.array([e for c in tree.children for e in c], dtype=np.int64)
        self.child = np.array([x for c in tree.children for x in c.values()], dtype=np.int64)

    def near(self, x: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the values within the radius, and how far they are."""
        level, found, far = np.zeros(1, dtype=np.int64), [], []
        while len(level):
            d = np.bitwise_count(self.values[level] ^ x).astype(np.int64)
            found.append(level[d <= radius])
            far.append(d[d <= radius])
            edges, of = _ranges(self.first[level], self.count[level])
            level = self.child[edges[np.abs(self.edge[edges] - d[of]) <= radius]]
        return np.concatenate(found), np.concatenate(far)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first..first+count of each, one after the other; and whose each is."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count - first, count), of


def _joins(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Joins of a block's texts (by number) that connect what is alike; label: which are joined already.

    side: if it is given, only texts of two sides are compared.
    """
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    inside = np.arange(len(fp)) if side is None else np.flatnonzero(side == 1)
    if not len(inside):
        return []
    values, where = np.unique(fp[inside], return_inverse=True)
    tree = Tree(values)
    members = inside[np.argsort(where, kind="stable")]
    held = np.bincount(where)
    begin = np.cumsum(held) - held
    out = []
    for i in inside.tolist() if side is None else np.flatnonzero(side == 0).tolist():
        found, far = tree.near(fp[i], radius)
        at, of = _ranges(begin[found], held[found])
        others, far = members[at], far[of]
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        wanted = (label[others] != label[i]) & (small >= similarity * large)
        if side is None:
            wanted &= others < i
        others = others[wanted][np.argsort(far[wanted], kind="stable")]
        mark[flat[first[i] : first[i] + size[i]]] = True
        step = 4
        while len(others):  # the nearest first: mostly the rest is joined then
            some, others = others[:step], others[step:]
            at, of = _ranges(first[some], size[some])
            common = np.bincount(of, weights=mark[flat[at]], minlength=len(some))
            for j in some[common >= similarity * (size[some] + size[i] - common)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
            others = others[label[others] != label[i]]
            step = min(256, 4 * step)
        mark[flat[first[i] : first[i] + size[i]]] = False
    return out


def _linked(radius: int, similarity: float):
    """u, v: the joins of each block (key, kind, x, y), whose rows come together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []

        def close() -> None:
            side, fp, node, root = (np.concatenate([h[i] for h in held]) for i in range(4))
            if (root == root[0]).all():
                return
            sets = [np.frombuffer(x, "<u4") for h in held for x in h[4]]
            made = _joins(fp, sets, np.unique(root, return_inverse=True)[1], side if key[2] != key[3] else None, radius, similarity)
            out.extend((max(a, b), min(a, b)) for a, b in ((int(node[i]), int(node[j])) for i, j in made))

        def frame() -> pd.DataFrame:
            done = pd.DataFrame(sorted(set(out)), columns=["u", "v"])
            out.clear()
            return done

        for b in batches:
            names = [b[c].to_numpy() for c in ("key", "kind", "x", "y")]
            rows = [b["side"].to_numpy(), b["fp"].to_numpy(np.int64).view(np.uint64), b["node"].to_numpy(), b["root"].to_numpy(), b["grams"].tolist()]
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in names], axis=0)]).tolist() if len(b) else []
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                if (at := tuple(int(c[i]) for c in names)) != key:
                    if held:
                        close()
                        if len(out) > 100_000:
                            yield frame()
                    key, held = at, []
                held.append([c[i:j] for c in rows])
        if held:
            close()
        if out:
            yield frame()

    return run


def _blocks(rows: DataFrame, shard: int) -> DataFrame:
    """key, kind, x, y, side, node, root: rows (key, n, major, most, node, root) dealt so that every two whose roots differ meet.

    Of n shingles, most are of texts with the root major. The others are dealt to parts, and every two parts meet (kind
    0); the parts of those of the major root, which needn't meet one another, meet every part of the others (kind 1).
    """
    minor = F.ceil((F.col("n") - F.col("most")) / shard).cast("long")
    major = F.ceil(F.col("most") / shard).cast("long")
    part = F.pmod(F.xxhash64("node", "key"), F.when(F.col("root") == F.col("major"), major).otherwise(minor))
    known = rows.select("key", "node", "root", minor.alias("minor"), major.alias("others"), part.alias("part"), (F.col("root") == F.col("major")).alias("big"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    own = F.transform(numbers("minor"), lambda i: at(0, F.least(i, "part"), F.greatest(i, "part"), F.col("part") > i))
    few = F.transform(numbers("others"), lambda i: at(1, F.col("part"), -1 - i, F.lit(0)))
    many = F.transform(numbers("minor"), lambda i: at(1, i, -1 - F.col("part"), F.lit(1)))
    return known.select("key", "node", "root", F.explode(F.when(F.col("big"), many).otherwise(F.concat(own, few))).alias("b")).select("key", "b.*", "node", "root")


def links(texts: DataFrame, described: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """node, component of every text that is alike to another; texts: node, least, n (a row for each text); described: node, fp, grams."""
    shard, parts = shard or SHARD, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = lambda x: F.lit(x).cast("long")

    hashes = texts.select("node", "n", F.posexplode(F.slice("least", 1, HASHES)).alias("j", "h")).select(F.xxhash64("j", "h").alias("key"), "node", "n")
    shared = hashes.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("all")).where("texts > 1").drop("texts")
    known = stored(hashes.join(shared, "key"), "known", few=True)
    ids = known.select(F.col("node").alias("key")).distinct()
    sets = split(described.select("node", "fp", "grams"), ids, "node")[0].groupBy("node").agg(F.first("fp").alias("fp"), F.first("grams").alias("grams"))

    def joined(blocks: DataFrame) -> DataFrame:
        rows = blocks.join(sets, "node").repartition(parts, "key", "kind", "x", "y").sortWithinPartitions("key", "kind", "x", "y", "node")
        return rows.select("key", "kind", "x", "y", "side", "node", "root", "fp", "grams").mapInPandas(tidy(_linked(radius, similarity)), "u long, v long")

    dealt = F.when(F.col("all") > shard, F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("all") / shard).cast("long"))).otherwise(long(0))
    of = components(joined(known.select("key", F.lit(0).alias("kind"), dealt.alias("x"), dealt.alias("y"), F.lit(0).alias("side"), "node", F.col("node").alias("root"))))
    hot = known.where(F.col("all") > shard).select("node").distinct()
    if hot.isEmpty():
        return of
    # the further hashes are keys of their own: a text of several hot shards meets the others once by each
    further = texts.select(F.col("node").alias("t"), "n", F.posexplode(F.slice("least", HASHES + 1, HASHES)).alias("j", "h"))
    again = hot.join(further, F.col("node") == F.col("t")).select(F.xxhash64(F.lit("further"), "j", "h").alias("key"), "node", "n")
    roots = of.withColumnsRenamed({"node": "t", "component": "root"})
    again = again.join(roots, F.col("node") == F.col("t"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = again.groupBy("key", "root").agg(F.sum("n").alias("s")).groupBy("key").agg(F.sum("s").alias("all"), F.max(F.struct("s", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    open_ = stored(again.join(sizes.select("key", F.col("all"), F.col("m.root").alias("major"), F.col("m.s").alias("most")), "key").drop("n").withColumnRenamed("all", "n"), "open", few=True)
    whole = open_.where(F.col("n") <= shard).select("key", F.lit(0).alias("kind"), long(0).alias("x"), long(0).alias("y"), F.lit(0).alias("side"), "node", "root")
    more = stored(joined(whole.unionByName(_blocks(open_.where(F.col("n") > shard), shard))), "more", gathered=True)
    return of if more.isEmpty() else components(more.unionByName(of.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def groups(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node (a hash of id and text), doc_id, group_id, kept: every distinct row of docs; groups of copies and near copies keep one."""
    node = F.xxhash64("doc_id", "text")
    rows = docs.select(node.alias("node"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    described = stored(rows.mapInPandas(tidy(_described(k)), "node long, doc_id long, d1 long, d2 long, fp long, least array<long>, n long, grams binary"), "copies")
    texts = stored(described.groupBy("d1", "d2").agg(F.min("node").alias("node"), F.min(F.struct("doc_id", "node")).alias("first"), F.first("least").alias("least"), F.first("n").alias("n")), "texts", few=True)
    of = links(texts, described, similarity).withColumnRenamed("node", "t")
    rooted = texts.join(of, F.col("node") == F.col("t"), "left").select("d1", "d2", "first", F.coalesce("component", "node").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("least")), "least", few=True)
    of = rooted.join(least, "root").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "least")
    joined = described.select("node", "doc_id", "d1", "d2").distinct().join(of, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    return joined.select("node", "doc_id", F.col("least.doc_id").alias("group_id"), (F.col("node") == F.col("least.node")).alias("kept"))


def without_near_copies(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group (the smallest id), once."""
    names, spark, since = docs.columns, docs.sparkSession, made(docs.sparkSession)
    of = stored(groups(docs, k, similarity), "groups", few=True)
    dropped(spark, since, of)
    keyed = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.xxhash64("doc_id", "text").alias("node"))
    repeated = keyed.groupBy("node").count().where("count > 1").select(F.col("node").alias("key"))
    gone = stored(of.where("NOT kept").select(F.col("node").alias("key"), F.lit(True).alias("gone")).unionByName(repeated.withColumn("gone", F.lit(False))).groupBy("key").agg(F.max("gone").alias("gone")), "gone", few=True)
    dropped(spark, since, gone)
    inside, outside = split(keyed, gone.select("key"), "node")
    left = inside.join(gone.where("gone").select("key"), F.col("node") == F.col("key"), "left_anti").dropDuplicates(["node"])
    return left.unionByName(outside).select("row.*")
