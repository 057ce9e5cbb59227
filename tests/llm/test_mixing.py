from samples import ODD
from oracle import same_rows
from pyspark.sql import functions as F

from umbra.llm import mixing as M


def by_rounds(sizes, weights, share, repeats):
    """Targets by giving out, cutting and giving out again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [repeats * s for s in sizes]
    full: set[int] = set()
    while True:
        left = share * sum(sizes) - sum(caps[i] for i in full)
        free = sum(w[i] for i in range(len(sizes)) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and left * w[i] / free >= caps[i]} if free else set()
        if not over:
            return [caps[i] if i in full else left * w[i] / free for i in range(len(sizes))]
        full |= over


def test_targets():
    for sizes in ([10, 20, 30], [1000, 1, 1, 1], [5], [0, 0, 7], [93091, *range(100, 2000, 100)]):
        got = M.targets(sizes, (3, 1, 2), 1.5, 2)
        assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, by_rounds(sizes, (3, 1, 2), 1.5, 2), strict=True))
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))


def test_against_sql(spark, sf_dir):
    same_rows(M.op10_mixing(spark, sf_dir), M.OP10_SQL, sf_dir)


def test_near_targets_and_again(made):
    docs = made([(i, "w " * (i % 37 + 1), None if i % 3 == 0 else f"s{i % 5}") for i in range(600)])
    rows = M.sized(docs)
    got = M.taken(rows, M.plan(rows))
    sums = got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t"), F.max("copies").alias("c")).collect()
    assert all(abs(r.n - r.t) <= 37 and r.c <= 2 for r in sums)
    a, b = (sorted(map(str, M.mix(docs).collect())) for _ in range(2))
    assert a == b and len(a) == got.agg(F.sum("copies")).first()[0]


def test_odd_rows(odd, none):
    rows = M.sized(odd)
    got = [tuple(r) for r in M.taken(rows, M.plan(rows)).select("doc_id", "size", "copies").collect()]
    assert len(got) == len(ODD) and dict((d, s) for d, s, _ in got)[1] == 0 and dict((d, s) for d, s, _ in got)[6] == 3000
    assert len({c for d, _, c in got if d == 5}) == 1
    assert M.mix(odd).columns == odd.columns and M.mix(none).count() == 0
    empty = M.sized(odd.where("text IS NULL OR text = ''"))
    assert all(r.copies == 0 for r in M.taken(empty, M.plan(empty)).collect())


def test_many_sources(made):
    """Thousands of sources cost the driver a row each; each comes as near to its target as one document's words."""
    docs = made([(i, "w " * (i % 13 + 1), f"s{i % 3000:04d}") for i in range(12_000)])
    rows = M.sized(docs)
    got = M.taken(rows, M.plan(rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect()
    assert len(got) == 3000 and all(abs(r.n - r.t) <= 13 for r in got)
