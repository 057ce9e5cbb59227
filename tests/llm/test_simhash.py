import random
import re

import numpy as np
import xxhash
from samples import ODD, stories
from pyspark.sql import functions as F

from umbra.llm import simhash as H
from umbra.llm.components import components


def fingerprint(text):
    """By the definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def by_pairs(fps, radius):
    """The smallest index that each reaches, over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in H.op7_simhash(spark, sf_dir).collect()}
    fps = [fingerprint(t) for _, t in docs]
    assert [got[d][0] for d, _ in docs] == fps
    assert [got[d][1] for d, _ in docs] == [docs[i][0] for i in by_pairs(fps, 2)]


def test_dense_and_sparse_fingerprints(spark):
    """Shards above the limit are divided down to the last level, and no link is lost."""
    r = random.Random(1)
    base = r.getrandbits(64)
    near = {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for _ in range(900)}
    far = {r.getrandbits(64) for _ in range(500)}
    fps = sorted(near | far | {0, (1 << 64) - 1})
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    for shard in (16, 256):
        comp = {x.node: x.component for x in components(H.links(rows.select("fp"), shard=shard)).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        want = by_pairs(fps, 2)
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(comp.get(f, f), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_tree_is_a_set():
    r = random.Random(2)
    values = [r.getrandbits(64) for _ in range(300)] * 2
    tree = H.BKTree()
    for v in values:
        tree.add(v)
    assert len(tree.values) == 300
    for q in values[:20]:
        assert set(tree.near(q, 28)) == {v for v in values if (v ^ q).bit_count() <= 28}


def test_odd_rows(odd, none):
    rows = H.fingerprints(odd)
    got = [tuple(x) for x in rows.join(H.classes(rows), "fp").select("doc_id", "fp", "component_id").collect()]
    assert len(got) == len(ODD)
    by = {d: (f, c) for d, f, c in got}
    assert by[1] == by[2] == by[4] == (0, 1) and by[5][1] == 5 and by[None][1] is None
    empty = H.fingerprints(none)
    assert H.classes(empty).count() == 0


def test_hot_copies(made):
    texts = stories(3)
    rows = H.fingerprints(made([(i, texts[0] if i % 3 else texts[1]) for i in range(300)]))
    assert {(x.component_id, x.n) for x in rows.join(H.classes(rows), "fp").groupBy("component_id").agg(F.count("*").alias("n")).collect()} == {(0, 100), (1, 200)}
