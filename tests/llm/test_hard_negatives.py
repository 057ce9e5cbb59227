import math
import random

import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from umbra.llm import hard_negatives as H

KIND = "vec_id long, label int, embedding array<float>, row int, range int, k int, windows int"


def plainly(rows, positives=5, negatives=10, low=30, high=90):
    """By all pairs, in whole numbers of any size."""
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (a, of, v) in enumerate(fine):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, lab == of) for m, (i, lab, w) in enumerate(fine) if m != n and len(w) == len(v)]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            window = sorted((s for s in scored if not s[2] and low * ps <= 100 * s[0] <= high * ps), key=order)[:negatives]
            out += [(a, p, k + 1, i, ps, ns) for k, (ns, i, _) in enumerate(window)]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, seed, dim=6, scale=lambda r: 1.0, labels=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = scale(r)
        out.append((i, r.randrange(labels), [float(np.float32(k * r.gauss(0.3, 1))) for _ in range(dim)]))
    return out


def at(monkeypatch, **names):
    for k, v in names.items():
        monkeypatch.setattr(H, k, v)


@pytest.mark.parametrize("scale", [lambda r: 1.0, lambda r: math.exp(r.gauss(0, 1.5)), lambda r: r.choice([0.0, 1.0, 40000.0])])
@pytest.mark.parametrize("shape", [{}, {"RANGE": 40, "BLOCK": 2, "BUCKET": 16}])
def test_as_by_all_pairs(spark, monkeypatch, scale, shape):
    at(monkeypatch, **shape)
    rows = vectors(420, 5, scale=scale)
    anchors = [(100 * i, lab, v) for i, lab, v in rows[:9]]
    rows = anchors + [(7 * i + 1, lab, v) for i, lab, v in rows[9:] if (7 * i + 1) % 100]
    assert found(H.mined(table(spark, rows), F.col("vec_id") % 100 == 0)) == plainly(rows)


def test_odd_rows(spark, monkeypatch):
    at(monkeypatch, RANGE=8, BUCKET=4)
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 2.0]), (100, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, None, [1.0, 2.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 2, [nan, 1.0]), (6, 2, [1.0, -inf])]
    rows += [(None, 1, [1.0, 1.5]), (None, 2, [0.5, 0.5]), (7, 2, [0.0, 0.0]), (8, 2, [0.5, 0.5]), (9, 2, [0.5, 0.5, 0.5]), (10, 2, []), (200, 2, []), (11, 1, []), (300, 5, [0.0, 0.0]), (12, 5, [0.0, 0.0])]
    rows += [(20 + i, 2, [0.4, 0.6]) for i in range(15)] + [(400, 9, [1.0, 1.0]), (500, 8, [-1.0, 0.0]), (501, 8, [1.0, 0.0])]
    assert found(H.mined(table(spark, rows), F.col("vec_id") % 100 == 0)) == plainly(rows)
    assert H.mined(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert H.mined(table(spark, [(1, 1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert H.mined(table(spark, [(100, 1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert H.mined(table(spark, [(100, 1, [3e8, 1.0]), (1, 1, [1e30, 0.0]), (2, 2, [3e38, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_copies_of_one_vector(spark, monkeypatch):
    at(monkeypatch, RANGE=64, BUCKET=32)
    rows = [*vectors(150, 8), *[(1000 + i, 2, [1.0] * 6) for i in range(200)]]
    assert found(H.mined(table(spark, rows), F.col("vec_id") % 100 == 0)) == plainly(rows)


def test_large_whole_numbers_are_exact(spark):
    r = random.Random(2)
    rows = [(i, i % 2, [float(r.randrange(1 << 19)) for _ in range(4)]) for i in range(130)]
    assert found(H.mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 100 == 0)) == plainly(rows)


def test_short_buckets_are_skipped(monkeypatch):
    """With a tail of short candidates almost nothing is multiplied, and nothing is lost."""
    made, plain = [], H.products
    monkeypatch.setattr(H, "products", lambda a, b, bound: made.append(len(a) * len(b)) or plain(a, b, bound))
    block = H.Block(5, True)
    block.add(0, 1, 1000.0, np.array([1000, 0]), [{"k": 0, "low": H.LEAST, "high": H.NO_ID, "kth": H.LEAST}])
    block.close()
    for k in range(50):
        size = 1000 >> min(k, 9)
        block.meet(np.arange(1, 21) + 20 * k, np.arange(1, 21) + 20 * k, np.ones(20, np.int64), np.full(20, float(size)), [np.array([size, 0])] * 20)
    assert len(made) == 1 and block.found[0][0][1].tolist() == [1, 2, 3, 4, 5]


def test_query(spark, sf_dir):
    same_rows(H.op11_hard_negatives(spark, sf_dir), H.OP11_SQL, sf_dir)
