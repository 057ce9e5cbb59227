import random

from umbra.llm.components import Union, components


def test_random_graphs(spark):
    r = random.Random(0)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(100)] + [(-3, -9)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert all(got.get(x, x) == union.find(x) for x in nodes)
    assert got[1060] == 1000 and got[-3] == -9


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
