"""Embedding near-duplicates within cells of spherical k-means.

Equal vectors are one, with their number. Centres are fitted on a sample of SAMPLE vectors at most (those of lowest hash);
every vector has a home cell, the nearest, and visits up to PROBES - 1 more whose cosine is within MARGIN of the home's.
Cells are so many that each holds PER_CELL vectors or so. Where these would be over MOST_CELLS, each cell is divided the
same way by centres of its own, fitted on some SAMPLE of its members: enough for MOST_CELLS * SAMPLE / 8 cells, a
thousand million vectors; its vectors are dealt out, and each part is given the cell's centres.
A cell's members meet its visitors in blocks of about BLOCK by cosine products in double precision; a pair that could be
met in two cells counts in one. Blocks return sums of links and labels that span them, not pairs. Of each component the
smallest vec_id is kept.

Recall: a pair is missed only if neither vector visits the other's home. The tests measure it against brute force; it is
1.0 on the test tables, and at least 0.99 for random pairs planted at cosines just above the threshold.

Defined cases: a vector that is null, zero, or holds null or non-finite values links with nothing; vectors of different
lengths don't link; a row without vec_id links with nothing and has no component; rows with one vec_id are one node; equal
vectors count as links of each other; an empty table has no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy
from .components import components

SAMPLE, PER_CELL, MOST_CELLS, PROBES, MARGIN, BLOCK, STEPS = 16384, 512, 1024, 8, 0.25, 1024, 6
#: Numbers for the cells inside a cell; vectors of a cell that are given its centres at once.
INSIDE, DEALT = 1 << 20, 1 << 16


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """k unit centres of unit rows; an empty cell begins again at the row that fits worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(steps):
        near = x @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size < 1e-9)
        worst = np.argsort(near[np.arange(len(x)), home])[: len(empty)]
        sums[empty[: len(worst)]] = x[worst]
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size < 1e-9, centres, sums / np.maximum(size, 1e-300))
    return centres


def _usable(v: Column) -> Column:
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def _cells(centres: dict[int, np.ndarray], probes: int, margin: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby(b["embedding"].map(len)):
                c = centres.get(dim)
                if c is None:  # a length that the sample doesn't hold: one cell
                    cells = np.zeros((len(rows), 1), dtype=np.int64)
                    visits = np.ones((len(rows), 1), dtype=bool)
                else:
                    cells, visits = _nearest(unit(rows["embedding"].tolist()), c, probes, margin)
                yield pd.DataFrame({"id": rows["id"], "n": rows["n"], "dim": dim, "home": cells[:, 0], "cells": [r[v].tolist() for r, v in zip(cells, visits, strict=True)], "embedding": rows["embedding"]})

    return run


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centres of unit rows, the best first, and which of them are within the margin of the best."""
    near = x @ centres.T
    n = min(probes, near.shape[1])
    cells = np.argpartition(-near, n - 1, axis=1)[:, :n]
    close = np.take_along_axis(near, cells, axis=1)
    order = np.argsort(-close, axis=1, kind="stable")
    cells, close = np.take_along_axis(cells, order, axis=1), np.take_along_axis(close, order, axis=1)
    return cells, close >= close[:, :1] - margin


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """dim, cell, centres (one after the other) of each cell's sample; k says how many."""
    at, held = None, []

    def done() -> pd.DataFrame:
        rows = pd.concat(held)
        x = unit(rows["embedding"].tolist())
        k = min(int(rows["k"].iloc[0]), max(1, len(x) // 8))
        return pd.DataFrame({"dim": [at[0]], "cell": [at[1]], "centres": [spherical_kmeans(x, k).ravel()]})

    for b in batches:
        for key, rows in b.groupby(["dim", "cell"], sort=False):
            if key != at:
                if held:
                    yield done()
                at, held = key, []
            held.append(rows)
    if held:
        yield done()


def _inside(probes: int, margin: float):
    """id, home and cells of vectors that follow the centres of their cell (head)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, centres = None, None
        for b in batches:
            for (dim, cell, _), rows in b.groupby(["dim", "cell", "part"], sort=False):
                first = rows["head"].to_numpy(dtype=bool)
                if first.any():
                    at, centres = (dim, cell), np.asarray(rows["centres"][first].iloc[0], dtype=np.float64).reshape(-1, dim)
                rows = rows[~first]
                if not len(rows):
                    continue
                if at != (dim, cell):  # no member of the sample: one cell
                    cells, close = np.zeros((len(rows), 1), dtype=np.int64), np.ones((len(rows), 1), dtype=bool)
                else:
                    cells, close = _nearest(unit(rows["embedding"].tolist()), centres, probes, margin)
                cells = cells + int(cell) * INSIDE
                home = np.where(rows["own"].to_numpy(dtype=bool), cells[:, 0], -1)
                yield pd.DataFrame({"id": rows["id"], "home": home, "cells": [r[v].tolist() for r, v in zip(cells, close, strict=True)]})

    return run


def divided(placed: DataFrame, sample: int, per_cell: int, probes: int, margin: float) -> DataFrame:
    """placed (id, n, dim, home, cells, embedding) with cells inside the cells."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(placed.dtypes)["embedding"]
    members = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("members"))  # MOST_CELLS rows for each length
    own = placed.select("id", "dim", F.col("home").alias("cell"), "embedding").join(F.broadcast(members), ["dim", "cell"])
    few = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("members")
    chosen = own.where(few).withColumn("k", F.ceil(F.col("members") / per_cell).cast("int"))
    centres = stored(chosen.repartition(parts, "dim", "cell").sortWithinPartitions("dim", "cell", F.xxhash64("id"), "id").mapInPandas(tidy(_fit), "dim int, cell long, centres array<double>"), "centres")
    at = placed.select("id", "dim", "home", F.explode("cells").alias("cell"), "embedding").join(F.broadcast(members), ["dim", "cell"], "left")
    count = F.ceil(F.coalesce("members", F.lit(1)) / DEALT)
    rows = at.select("dim", "cell", F.pmod(F.xxhash64("id", F.lit(2)), count).alias("part"), F.lit(False).alias("head"), "id", (F.col("cell") == F.col("home")).alias("own"), F.lit(None).cast("array<double>").alias("centres"), "embedding")
    heads = centres.join(F.broadcast(members), ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / DEALT) - 1)).alias("part"), F.lit(True).alias("head"), F.lit(0).cast("long").alias("id"), F.lit(False).alias("own"), "centres", F.lit(None).cast(kind).alias("embedding"))
    inside = heads.unionByName(rows).repartition(parts, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", F.desc("head"), "id").mapInPandas(tidy(_inside(probes, margin)), "id long, home long, cells array<long>")
    found = inside.groupBy("id").agg(F.max("home").alias("home"), F.flatten(F.collect_list("cells")).alias("cells"))
    return placed.drop("home", "cells").join(found, "id").select("id", "n", "dim", "home", "cells", "embedding")


def _compare(threshold: float, most: int):
    """Rows of one block after another, its members first: what each vector gained in links, and its label in the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, members, x, probes = None, [], None, None

        def label(ids_a, ids_b, found):
            la, lb = ids_a.copy(), ids_b.copy()
            big = np.iinfo(np.int64).max
            while True:
                na = np.minimum(la, np.where(found, lb[None, :], big).min(axis=1, initial=big))
                nb = np.minimum(lb, np.where(found, na[:, None], big).min(axis=0, initial=big))
                if (na == la).all() and (nb == lb).all():
                    return la, lb
                la, lb = na, nb

        def rows(ids, gain, labels):
            keep = (gain > 0) | (labels != ids)
            return pd.DataFrame({"id": ids[keep], "links": gain[keep], "label": labels[keep]})

        def within() -> Iterator[pd.DataFrame]:
            nonlocal members, x, probes
            members = pd.concat(members)
            x = unit(members["embedding"].tolist())
            probes = np.full((len(members), most), -1, dtype=np.int64)
            for i, c in enumerate(members["cells"]):
                probes[i, : len(c)] = c
            ids, n = members["id"].to_numpy(np.int64), members["n"].to_numpy(np.int64)
            for i in range(0, len(members), BLOCK):
                for j in range(i, len(members), BLOCK):
                    found = x[i : i + BLOCK] @ x[j : j + BLOCK].T >= threshold
                    if i == j:
                        found = np.triu(found, 1)
                    found &= ids[i : i + BLOCK, None] != ids[None, j : j + BLOCK]
                    if found.any():
                        la, lb = label(ids[i : i + BLOCK], ids[j : j + BLOCK], found)
                        yield rows(ids[i : i + BLOCK], found @ n[j : j + BLOCK], la)
                        yield rows(ids[j : j + BLOCK], n[i : i + BLOCK] @ found, lb)

        def against(guests: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, n = members["id"].to_numpy(np.int64), members["n"].to_numpy(np.int64)
            for k in range(0, len(guests), BLOCK):
                g = guests.iloc[k : k + BLOCK]
                y, gid, gn, home = unit(g["embedding"].tolist()), g["id"].to_numpy(np.int64), g["n"].to_numpy(np.int64), g["home"].to_numpy(np.int64)
                for i in range(0, len(members), BLOCK):
                    mid = ids[i : i + BLOCK]
                    found = (x[i : i + BLOCK] @ y.T >= threshold) & (mid[:, None] != gid[None, :])
                    if not found.any():
                        continue
                    # met in the smaller id's home; in the larger's only if the larger doesn't visit the smaller's
                    a, b = np.nonzero(found & (home != at[1])[None, :] & (mid[:, None] > gid[None, :]))
                    twice = (probes[i + a] == home[b, None]).any(axis=1)
                    found[a[twice], b[twice]] = False
                    la, lb = label(mid, gid, found)
                    yield rows(mid, found @ gn, la)
                    yield rows(gid, n[i : i + BLOCK] @ found, lb)

        for batch in batches:
            for key, part in batch.groupby(["dim", "cell", "block"], sort=False):
                if key != at:
                    if isinstance(members, list) and members:
                        yield from within()
                    at, members = key, []
                own, guests = part[~part["guest"]], part[part["guest"]]
                if len(own):
                    members.append(own)
                if len(guests):
                    if isinstance(members, list):
                        if not members:
                            continue
                        yield from within()
                    yield from against(guests)
        if isinstance(members, list) and members:
            yield from within()

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.95, sample: int = SAMPLE, per_cell: int = PER_CELL, probes: int = PROBES, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("vec_id").cast("long"), "embedding")
    usable = _usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    keyed = rows.withColumns({"d1": F.when(usable, F.xxhash64("embedding")), "d2": F.when(usable, F.xxhash64("embedding", F.lit(1)))})
    vectors = stored(keyed.where(usable).groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vectors")
    count = vectors.count()
    fitted: dict[int, list] = {}
    for r in vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect():
        fitted.setdefault(len(r.embedding), []).append(np.asarray(r.embedding, dtype=np.float64))
    cells = max(1, min(MOST_CELLS, -(-count // per_cell)))
    centres = {dim: spherical_kmeans(unit(x), min(cells, len(x))) for dim, x in fitted.items()}
    kind = dict(rows.dtypes)["embedding"]
    placed = stored(vectors.select("id", "n", "embedding").mapInPandas(tidy(_cells(centres, probes, margin)), f"id long, n long, dim int, home long, cells array<long>, embedding {kind}"), "cells")
    most = probes
    if -(-count // per_cell) > MOST_CELLS:
        placed, most = stored(divided(placed, sample, per_cell, probes, margin), "cells"), probes * probes
    blocks = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    at = placed.withColumn("cell", F.explode("cells")).join(blocks, ["dim", "cell"])
    numbers = F.when(F.col("cell") == F.col("home"), F.sequence(F.lit(0), own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = at.withColumns({"own": own, "block": F.explode(numbers)}).withColumn("guest", (F.col("cell") != F.col("home")) | (F.col("block") != F.col("own"))).drop("own", "blocks")
    found = stored(met.repartition(parts, "dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "guest", "id").mapInPandas(tidy(_compare(threshold, most)), "id long, links long, label long"), "found", gathered=True)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("u"), F.col("label").alias("v"))).withColumnRenamed("component", "root")
    of = vectors.select("d1", "d2", "id", "n").join(links, "id", "left").join(reached, F.col("id") == F.col("node"), "left").select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    # rows without a usable vector get keys that match nothing
    keyed = keyed.withColumn("d2", F.coalesce("d2", F.xxhash64("vec_id"))).select("vec_id", F.coalesce("d1", "d2").alias("d1"), "d2", usable.alias("usable"))
    joined = keyed.join(of.withColumns({"e1": F.col("d1"), "e2": F.col("d2")}).drop("d1", "d2"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & F.col("usable"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
