"""SimHash near-duplicates with BK-trees.

A text's fingerprint has a bit for each of 64: 1 if it is set in over half the hashes of its word shingles. Two
fingerprints link at `radius` (2) or fewer differing bits. Of four 16-bit bands, two at least are equal in such a pair;
so each fingerprint goes to the six shards of its band pairs, and a shard's BK-tree (children keyed by their Hamming
distance to the parent) is searched along edges within the radius. A shard of over SHARD fingerprints is divided again by
band pairs of the bits that it leaves open, where it agrees on 48, then 56 bits; the last can hold 256 values at most.
Shard trees meet their queries by this key and not by broadcast: they grow with the data, a key's tree doesn't.

Only distinct fingerprints enter the trees; a shard returns a spanning set of links, not all pairs.

Defined cases: null and empty texts have no shingle and the fingerprint 0, which links like any other; fewer words than
a shingle needs are one shingle; equal rows share a fingerprint; a null id is never the name of a component that has
another id; an empty table has no rows; other columns don't matter; the shingles of a very long text are hashed 65,536 at a time
and counted, in memory of some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table, tidy, words
from .components import Union, components

RADIUS, SHARD = 2, 256


def simhash(text: str | None, k: int) -> int:
    """The 64-bit fingerprint, unsigned."""
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(g, seed=42) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):  # of any length in little memory
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([simhash(t, k) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(tidy(run), "doc_id long, fp long")


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at = 0
        while self.values:
            d = (x ^ self.values[at]).bit_count()
            if d == 0:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(x)
        self.children.append({})

    def near(self, x: int, radius: int) -> Iterator[int]:
        """The tree's values within the radius, by edges that can lead to one."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (x ^ self.values[at]).bit_count()
            if d <= radius:
                yield self.values[at]
            todo.extend(child for edge, child in self.children[at].items() if abs(edge - d) <= radius)


def _masks() -> list[tuple[int, int, int, int]]:
    """level, parent path, path, the bits on which a shard of that path agrees; a path's open bits halve with each level."""
    out, level = [], [(0, 0, list(range(64)))]
    for depth in (1, 2, 3):
        below = []
        for path, fixed, free in level:
            quarter = len(free) // 4
            bands = [free[i * quarter : (i + 1) * quarter] for i in range(4)]
            for j, pair in enumerate(combinations(range(4), 2)):
                child, mask = path * 6 + j + 1, fixed | sum(1 << b for i in pair for b in bands[i])
                out.append((depth, path, child, mask - (1 << 64) if mask >> 63 else mask))
                below.append((child, mask, [b for i in range(4) if i not in pair for b in bands[i]]))
        level = below
    return out


def _tree_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union = Union()
        key, held = None, []

        def close() -> None:
            if len(held) > 1:
                tree = BKTree()
                for x in held:
                    signed = x - (1 << 64) if x >> 63 else x
                    for y in tree.near(x, radius):
                        union.join(signed, y - (1 << 64) if y >> 63 else y)
                    tree.add(x)

        for b in batches:
            path, part, fp = (b[c].to_numpy() for c in ("path", "part", "fp"))
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (part[1:] != part[:-1])]) if len(b) else []
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                if (path[i], part[i]) != key:
                    close()
                    key, held = (path[i], part[i]), []
                held.extend(fp[i:j].view(np.uint64).tolist())
        close()
        if edges := union.edges():
            yield pd.DataFrame(edges, columns=["u", "v"])

    return run


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """u, v: links of distinct fingerprints (column fp) that span what all links within the radius connect."""
    if radius > 2:
        raise ValueError("two of four bands are sure to be equal only within a radius of 2")
    spark = values.sparkSession
    masks = small(spark, _masks(), "level int, parent int, path int, mask long")

    def deeper(rows: DataFrame, level: int) -> DataFrame:
        of = F.broadcast(masks.where(F.col("level") == level).select("parent", F.col("path").alias("child"), "mask"))
        return rows.join(of, F.col("path") == F.col("parent")).select(F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")

    rows, groups = deeper(values.select(F.lit(0).alias("path"), "fp"), 1), []
    for level in (2, 3):
        hot = stored(rows.groupBy("path", "part").count().where(F.col("count") > shard).select("path", "part", F.lit(True).alias("hot")), "hot", few=True)
        if hot.isEmpty():
            break
        marked = rows.join(hot, ["path", "part"], "left")
        groups.append(marked.where("hot IS NULL").select("path", "part", "fp"))
        rows = deeper(marked.where("hot"), level)
    groups.append(rows)
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, "path", "part").sortWithinPartitions("path", "part", "fp").mapInPandas(tidy(_tree_links(radius)), "u long, v long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id (the smallest doc_id that its links reach) of every fingerprint of rows (doc_id, fp)."""
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps", few=True)
    of = components(links(values.select("fp"), radius))
    rooted = values.join(of, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    # as a table, so that the join can split a very large component
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least", few=True)
    return rooted.join(least, "root").select("fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(fingerprints(table(spark, sf_dir, "documents"), 3), "simhash")
    return rows.join(classes(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
