import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import ODD, stories

from umbra.llm import language_model as L

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Plain:
    """The model by its formulas, with dictionaries."""

    def __init__(self, texts):
        uni, pairs = Counter(), Counter()
        for t in texts:
            w = [*t.encode().translate(LOWER).split(), b"END"]
            uni.update(w)
            pairs.update(zip([b"START", *w], w))
        self.uni, self.pairs, self.n, self.v = uni, pairs, sum(uni.values()), len(uni)
        self.total, self.after, self.kinds = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
        for (u, w), c in pairs.items():
            self.total[u] += c
            self.after[w] += 1
            self.kinds[u][min(c, 3) - 1] += 1
        of = lambda counts: (0.0, *L.discounts(*(sum(1 for c in counts if c == k) for k in (1, 2, 3, 4))))
        self.d, self.e = of(pairs.values()), of(self.after.values())
        self.mass = sum(self.e[min(c, 3)] for c in self.after.values()) / max(1, len(pairs)) if pairs else 1.0

    def low(self, w):
        c = self.after[w]
        return (c - self.e[min(c, 3)]) / max(1, len(self.pairs)) + self.mass / (self.v + 1)

    def p(self, u, w):
        if not self.total[u]:
            return self.low(w)
        c = self.pairs[(u, w)]
        return (c - self.d[min(c, 3)]) / self.total[u] + sum(d * k for d, k in zip(self.d[1:], self.kinds[u], strict=True)) / self.total[u] * self.low(w)

    def score(self, t):
        w = [*(t or "").encode().translate(LOWER).split(), b"END"]
        return sum(math.log10(self.p(u, x)) for u, x in zip([b"START", *w], w))

    def base(self, t):
        w = [*(t or "").encode().translate(LOWER).split(), b"END"]
        return sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w), len(w), sum(x in self.uni for x in w)


@pytest.mark.parametrize("block", [L.BLOCK_TOKENS, 3000])
def test_whole_table(spark, sf_dir, monkeypatch, block):
    """Against the formulas; small blocks and shards merge counts over many parts."""
    monkeypatch.setattr(L, "BLOCK_TOKENS", block)
    monkeypatch.setattr(L, "TOKENS_PER_SHARD", block)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    want = Plain([t for i, t in docs.items() if not held[i]])
    rows = L.op5_language_model(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base, n, known = want.base(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, want.n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - want.score(docs[r.doc_id])) < 1e-6 * max(1, -r.score)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_sums_to_one(made):
    texts = ["a b a c", "b a a", "c c a b", "a"]
    model = L.train(made(list(enumerate(texts))))
    reader, plain = L.Reader(model), Plain(texts)
    kinds = [b"a", b"b", b"c", L.END]
    h = np.array([L.word_hash(w) for w in kinds], dtype=np.uint64)
    known = reader.words(h)
    assert abs(known[:, 3].sum() + model.unknown - 1) < 1e-12
    d = np.array([0.0, *model.discounts])
    for u in (b"a", b"b", b"c", L.START):
        uh = np.full(4, L.word_hash(u), dtype=np.uint64)
        ctx = reader.words(uh)
        c = reader.pairs(uh, h)
        p = (c - d[np.minimum(c, 3)]) / ctx[:, 1] + ctx[:, 2] * known[:, 3]
        assert abs(p.sum() + ctx[0, 2] * model.unknown - 1) < 1e-12
        assert np.allclose(p, [plain.p({L.START: b"START"}.get(u, u), {L.END: b"END"}.get(w, w)) for w in kinds])


def test_odd_rows(odd, none, made):
    model = L.train(odd)
    rows = L.scored(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 4)) and all(r.score <= 0 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1 and L.scored(none, model).count() == 0
    empty = L.train(none)
    assert empty.tokens == 0 and all(r.score <= 0 and r.n_known == 0 for r in L.scored(made([(1, "a b")]), empty).collect())


def test_discounts():
    assert L.discounts(0, 0, 0, 0) == (0.5, 0.75, 0.9)
    assert all(0 <= d < k for d, k in zip(L.discounts(100, 30, 10, 4), (1, 2, 3), strict=True))


def test_a_shard_that_is_lost_is_an_error(made):
    docs = made(list(enumerate(stories(40))))
    model = L.train(docs)
    for kind in ("pair", "word"):
        name = sorted(f for f in os.listdir(model.folder) if f.startswith(kind) and f.endswith("-key.npy"))[0]
        whole = np.load(f"{model.folder}/{name}")
        for broken in (None, whole[:-1]):
            os.remove(f"{model.folder}/{name}")
            if broken is not None:
                np.save(f"{model.folder}/{name}", broken)
            with pytest.raises(Exception, match="shared folder"):
                L.scored(docs, model).collect()
            np.save(f"{model.folder}/{name}", whole)
    assert L.scored(docs, model).count() == 40


@pytest.mark.parametrize("most, shards", [(1 << 18, 36), (20, 20)])
def test_frequent_contexts_are_spread(made, monkeypatch, most, shards):
    """A context with more tokens than a shard's share has pairs in many shards; the number of shards is bounded."""
    monkeypatch.setattr(L, "TOKENS_PER_SHARD", 200)
    monkeypatch.setattr(L, "MOST_SHARDS", most)
    texts = [" ".join(f"the {w}" for w in t.split()) for t in stories(60, words=60, vocabulary=500)]
    docs, plain = made(list(enumerate(texts))), Plain(texts)
    model = L.train(docs)
    assert plain.n == 7260 and model.pair_shards == shards and set(model.hot) == {L.word_hash(b"the"), L.word_hash(L.START)}
    assert max(n for (kind, _), n in model.lengths.items() if kind == "pair") < 3 * 1000 / shards * 2
    assert all(abs(r.score - plain.score(texts[r.doc_id])) < 1e-6 * max(1, -r.score) for r in L.scored(docs, model).collect())
