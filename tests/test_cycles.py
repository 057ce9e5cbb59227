"""Strong components and cycles against closures of small graphs, and on graphs whose closure nobody could hold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from umbra.operators import cycles as C
from umbra.operators import locks as L

KIND = "a long, b long"


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for s in reach.values():
            more = set().union(s, *[reach.get(b, ()) for b in s])
            if len(more) > len(s):
                s |= more
                changed = True
    on = {a for a in reach if a in reach[a]}
    return {a: min(b for b in reach[a] if b in on and a in reach[b]) for a in on}


def graph(seed):
    r = random.Random(seed)
    n = r.randrange(1, 40)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 2 * n + 2))}
    at = n
    for _ in range(r.randrange(4)):  # chains, tails and rings between what is there
        k = r.randrange(1, 9)
        way = [r.randrange(n), *range(at, at + k), r.choice([r.randrange(n), at + k])]
        edges |= set(zip(way, way[1:], strict=False))
        at += k + 1
    return sorted(edges)


@pytest.mark.parametrize(("part", "gathered"), [(0, 0), (1, C.GATHERED)])
def test_components_and_cycles(spark, part, gathered, monkeypatch):
    """Several graphs at once, as parts of one: nodes of graph i are i * 1000 and on; by rounds, and in one task."""
    monkeypatch.setattr(C, "GATHERED", gathered)
    edges = [(1000 * i + a, 1000 * i + b) for i in range(30) for a, b in graph(30 * part + i)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 1), (1, None)], KIND)
    want = closure(edges)
    assert {r.node: r.component for r in C.strong_components(df).collect()} == want
    have, seen = set(edges), {}
    for r in C.witnesses(df).collect():
        seen.setdefault(r.component, {})[r.position] = r.node
    assert set(seen) == set(want.values())
    for component, steps in seen.items():
        way = [steps[i] for i in range(len(steps))]
        assert len(set(way)) == len(way) and way[0] == min(way)
        assert all(want[x] == component for x in way) and all(e in have for e in zip(way, [*way[1:], way[0]], strict=True))


def test_single_graphs(spark):
    for edges in ([(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], [(5, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 2), (4, 4)]):
        assert {r.node: r.component for r in C.strong_components(spark.createDataFrame(edges, KIND)).collect()} == closure(edges)
    none = spark.createDataFrame([], KIND)
    assert C.strong_components(none).count() == 0 and C.witnesses(none).count() == 0 and L.cycle_reports(none).count() == 0


@pytest.mark.parametrize(("n", "gathered", "seconds"), [(100_000, C.GATHERED, 30), (20_000, 1000, 90)])
def test_a_ring_of_100_000_locks(spark, n, gathered, seconds, monkeypatch):
    monkeypatch.setattr(C, "GATHERED", gathered)
    ring = spark.range(n).select(F.concat(F.lit("L"), F.col("id")).alias("a"), F.concat(F.lit("L"), (F.col("id") + 1) % n).alias("b"))
    began = time.time()
    assert L.on_cycles(ring).count() == n
    assert time.time() - began < seconds
    row = L.cycle_reports(ring, most=3).first()
    assert (row.lock, row.length, row.cycle) == ("L0", n, ["L0", "L1", "L2"])


def test_a_long_ring_with_ways_beside_it(spark, monkeypatch):
    """By rounds until few edges are left. Every tenth node has a second way, over a chain of its own, and tails lead in and out."""
    monkeypatch.setattr(C, "GATHERED", 500)
    n = 3000
    edges = [(i, (i + 1) % n) for i in range(n)]
    for i in range(0, n, 10):
        x = 10_000 + 10 * i
        edges += [(i, x), (x, x + 1), (x + 1, (i + 7) % n), (50_000 + i, i), (i, 90_000 + i)]
    got = {r.node: r.component for r in C.strong_components(spark.createDataFrame(edges, KIND)).collect()}
    assert set(got.values()) == {0} and set(got) == set(range(n)) | {10_000 + 10 * i + d for i in range(0, n, 10) for d in (0, 1)}


def test_a_dense_graph(spark):
    edges = spark.range(500).alias("x").join(spark.range(500).alias("y"), F.col("x.id") != F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    began = time.time()
    assert C.strong_components(edges).groupBy("component").count().collect()[0][1] == 500
    assert time.time() - began < 30
    assert [r.cycle for r in L.cycle_reports(edges).collect()] == [[0, 1, 0]]


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """No join of the rounds is a broadcast, and the session's own setting stands again afterwards."""
    monkeypatch.setattr(C, "GATHERED", 0)
    seen, kept = set(), C.Rounds.kept

    def watched(self, rows, *instead):
        seen.add("BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString())
        return kept(self, rows, *instead)

    monkeypatch.setattr(C.Rounds, "kept", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df = spark.createDataFrame([(i, i + 1 if i % 6 < 5 else i - 5) for i in range(60)] + [(3, 70), (70, 1)], KIND)
    assert L.cycle_reports(df).count() == 10 and seen == {False}
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
