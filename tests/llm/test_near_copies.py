import random

import numpy as np
import pytest
from samples import ODD, stories

from umbra.llm import near_copies as N


def edited(text, n, r):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def kept_by_pairs(docs):
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {sets[i][0] for i in range(len(sets)) if find(i) == i}


@pytest.mark.parametrize("shard", [N.SHARD, 1600])
def test_against_all_pairs(made, monkeypatch, shard):
    """Copies, near copies, texts that share a passage, and others; with small shards every level is used."""
    r = random.Random(5)
    base = stories(40, 200, 7)
    passage = stories(1, 60, 8)[0]
    docs = list(enumerate(base))
    for t in base[:20]:
        docs += [(len(docs) + i, x) for i, x in enumerate([t, edited(t, 2, r), edited(t, 3, r), edited(t, 30, r), passage + " " + stories(1, 120, r.random())[0]])]
    docs += [(len(docs) + i, edited(base[30], 2, r)) for i in range(60)]  # a large group of near copies
    monkeypatch.setattr(N, "SHARD", shard)
    assert {x.doc_id for x in N.without_near_copies(made(docs)).collect()} == kept_by_pairs(docs)


def test_odd_rows(odd, none):
    out = N.without_near_copies(odd)
    assert out.columns == odd.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert sorted(d for d, _ in got) == ["1", "3", "5", "6", "7", "8", "None"] and len(got) == len(ODD) - 3
    assert N.without_near_copies(none).count() == 0


def test_one_id_two_texts(made):
    a, b = stories(2)
    assert N.without_near_copies(made([(1, a), (1, b), (2, a)])).count() == 2


def family(n, r, template, own, edits):
    """n texts that share a template, and of every tenth a copy with some words changed."""
    common = stories(1, template, 11)[0]
    docs = [(i, common + " " + t) for i, t in enumerate(stories(n, own, 12))]
    return docs + [(n + i, edited(docs[10 * i][1], edits, r)) for i in range(n // 10)]


def test_family_of_a_template(made):
    """Unrelated texts of one template lie nearer than copies do; every copy is found."""
    docs = family(300, random.Random(6), 200, 60, 4)
    got = {x.doc_id for x in N.without_near_copies(made(docs)).collect()}
    assert got == kept_by_pairs(docs)


def test_family_in_large_shards(made, monkeypatch):
    """Shards above the bound are compared in blocks, so that no copy is lost."""
    docs = family(300, random.Random(9), 200, 60, 4)
    monkeypatch.setattr(N, "SHARD", 2000)
    got = {x.doc_id for x in N.without_near_copies(made(docs)).collect()}
    assert got == kept_by_pairs(docs)


def test_repeated_lines(made):
    """A line many times in one text and twice in the other leaves the likeness as it is."""
    docs = []
    for i, body in enumerate(stories(60, 200, 21)):
        line = " " + stories(1, 12, 100 + i)[0]
        docs += [(2 * i, body + 3 * line), (2 * i + 1, body + 20 * line)]
    got = {x.doc_id for x in N.without_near_copies(made(docs)).collect()}
    assert got == kept_by_pairs(docs) == set(range(0, 120, 2))


@pytest.mark.parametrize("shard", [N.SHARD, 20_000])
def test_edits_of_one_text(made, monkeypatch, shard):
    """Over a thousand edits of one text that isn't there itself, and other texts: exactly what all pairs give."""
    r = random.Random(31)
    base = stories(1, 200, 32)[0]
    docs = [(i, edited(base, r.randrange(1, 6), r)) for i in range(1200)] + [(2000 + i, t) for i, t in enumerate(stories(100, 200, 33))]
    monkeypatch.setattr(N, "SHARD", shard)
    assert {x.doc_id for x in N.without_near_copies(made(docs)).collect()} == kept_by_pairs(docs)


def test_tree_finds_all():
    """The array search of a BK-tree against all distances."""
    x = np.random.default_rng(2).integers(0, 1 << 63, 700).astype(np.uint64)
    x[300:500] = x[:200] ^ (np.uint64(1) << np.arange(200, dtype=np.uint64) % np.uint64(60))
    x = np.unique(x)
    tree = N.Tree(x)
    for q in x[::50].tolist():
        found, far = tree.near(np.uint64(q), 26)
        d = np.bitwise_count(x ^ np.uint64(q))
        assert sorted(found.tolist()) == np.flatnonzero(d <= 26).tolist() and (d[found] == far).all()


def test_recall_on_the_small_table(spark, sf_dir):
    """Every near copy of the whole small table is found, nothing else goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {x.doc_id for x in N.without_near_copies(docs).collect()}
    assert got == kept_by_pairs([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
