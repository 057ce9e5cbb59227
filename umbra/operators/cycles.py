"""Strong components of a directed graph, and a cycle of each, as Spark jobs over its edges.

No pairs of nodes are made: every table has a row for each node or edge at most. A node with one successor is contracted
into it, and so along whole chains, whose ends are found by following ways twice as far again and again; rings of such
nodes come out as components on the way, and what leads nowhere goes. The next time edges are turned round. Where that
stops helping, colours run along the edges (the least node that reaches each), and then backward from each colour's own
node: what both reach is a component. Contracted nodes are taken back last, latest first: those on a way out of a
component and into it again belong to it. A chain or ring takes rounds by its logarithm, what can't be contracted rounds
by its diameter. As soon as what is left has GATHERED edges at most, one task ends the work, as the rest of it fits there;
the rounds give the same without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.sources.folders import Rounds, without_broadcasts

#: Colours are used once two contractions, along and against the edges, leave more of them than this share.
LEFT = 0.75
#: Edges, or ways, that one task takes: some 100 bytes each.
GATHERED = 250_000


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node on a cycle; edges a, b. A null end is no edge; an edge from a node to itself is a cycle."""
    with without_broadcasts(edges.sparkSession):
        return _strong_components(edges)


def _strong_components(edges: DataFrame) -> DataFrame:
    rounds = Rounds(edges.sparkSession, "components")
    edges = rounds.kept(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops, rest = edges.where("a = b").select(F.col("a").alias("node")), edges.where("a != b")
    labels = edges.limit(0).select(F.col("a").alias("node"), F.col("a").alias("component"))
    layers: list[tuple[DataFrame, DataFrame]] = []
    counts = [rest.count()]
    while counts[-1]:
        if counts[-1] <= GATHERED:
            labels = labels.unionByName(rounds.kept(rest.repartition(1).mapInPandas(_components, labels.schema)))
            break
        if len(counts) > 2 and counts[-1] > LEFT * counts[-3]:
            rest, found = _coloured(rest, rounds)
            counts = [rest.count()]
        else:
            rest, found, layer = _contracted(rest, rounds)
            layers += layer
            counts.append(rest.count())
        labels = labels.unionByName(found)
    for layer in reversed(layers):
        labels = _taken_back(labels, *layer, rounds)
    least = labels.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    named = labels.join(least, "component").select("node", F.col("least").alias("component"))
    alone = loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = rounds.kept(named.unionByName(alone))
    rounds.ended(out)
    return out


def _numbered(batches: Iterator[pd.DataFrame], *columns: str) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray]:
    """All rows of a bounded table; the nodes of its columns as numbers in their order; the nodes."""
    rows = pd.concat([pd.DataFrame(), *batches])
    if not len(rows):
        return rows, [], np.array([])
    numbers, nodes = pd.factorize(np.concatenate([rows[c].to_numpy() for c in columns]), sort=True)
    return rows, np.split(numbers, len(columns)), nodes


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, component of the components of two nodes and more: one search in depth, with a stack of its own."""
    rows, ends, nodes = _numbered(batches, "a", "b")
    if not len(rows):
        return
    a, b = ends
    order = np.argsort(a, kind="stable")
    first, to = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist()
    seen, low, of = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    at, open_ = first[:-1], []  # the next edge of each node; nodes whose component isn't closed
    clock = 0
    for root in range(len(nodes)):
        way = [root] if seen[root] < 0 else []
        while way:
            x = way[-1]
            if seen[x] < 0:
                seen[x] = low[x] = clock
                clock += 1
                open_.append(x)
            if at[x] < first[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if seen[y] < 0:
                    way.append(y)
                elif of[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[x])
            if low[x] == seen[x]:  # x and what was opened after it
                members = [open_.pop()]
                while members[-1] != x:
                    members.append(open_.pop())
                for y in members:
                    of[y] = x
    of = np.array(of)
    some = np.flatnonzero(np.bincount(of, minlength=len(nodes))[of] > 1)
    yield pd.DataFrame({"node": nodes[some], "component": nodes[of[some]]})


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """followed() of a bounded table: doubled as often as a way can be long."""
    rows, ends, nodes = _numbered(batches, "x", "y")
    if not len(rows):
        return
    x, y = ends
    own = np.full(len(nodes), -1)
    own[x] = np.arange(len(x))
    opened, least, steps = rows["open"].to_numpy(dtype=bool).copy(), x.copy(), np.ones(len(x), dtype=np.int64)
    for _ in range(len(x).bit_length() + 1):
        then = own[y[opened]]
        if not len(then):
            break
        least[opened], steps[opened] = np.minimum(least[opened], least[then]), steps[opened] + steps[then]
        y[opened], opened[opened] = y[then], opened[then]
    yield pd.DataFrame({"x": nodes[x], "y": nodes[y], "open": opened, "least": nodes[least], "steps": steps})


def _farther(ways: DataFrame) -> DataFrame:
    """Ways (x, y, open: whether y has a way of its own, least of the nodes passed, steps) with that of y added."""
    on = ways.select(*[F.col(c).alias(f"_{c}") for c in ("x", "y", "open", "least", "steps")])
    then = lambda name, otherwise: F.when(F.col("open"), F.col(f"_{name}")).otherwise(otherwise).alias(name)
    return ways.join(on, F.col("open") & (F.col("y") == F.col("_x")), "left").select("x", then("y", F.col("y")), then("open", F.lit(False)), F.least("least", "_least").alias("least"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))


def followed(successors: DataFrame, rounds: Rounds) -> DataFrame:
    """Ways of successors (x, y, and open; one for each x), followed to their ends, or round and round where they have none (open).

    Those that stay open have passed the whole ring that they lead into, and their y are the nodes of rings.
    """
    ways = rounds.kept(successors.select("x", "y", "open", F.col("x").alias("least"), F.lit(1).cast("long").alias("steps")))
    if ways.count() <= GATHERED:
        return rounds.kept(ways.select("x", "y", "open").repartition(1).mapInPandas(_ways, ways.schema), ways)
    image = None
    while True:
        far = _farther(_farther(ways)).join(ways.select("x", F.col("least").alias("was")), "x")
        ways = rounds.kept(far, ways)
        n = ways.where("open").agg(F.count("*").alias("open"), F.sum((F.col("least") != F.col("was")).cast("long")).alias("changed"), F.countDistinct("y").alias("image")).first()
        if not n.open or (not n.changed and n.image == image):
            return ways
        image, ways = n.image, rounds.alias(ways, ways.drop("was"))


def _contracted(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The edges that are left, turned round; node, component of rings; what _taken_back() needs.

    Nodes with one successor (x) become the end of their way (y), or go where that end has no successor.
    """
    starts = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    single = starts.where("n = 1").select(F.col("a").alias("x"), F.col("b").alias("y"))
    single = rounds.kept(single.join(single.select(F.col("x").alias("_x")), F.col("y") == F.col("_x"), "left").select("x", "y", F.col("_x").isNotNull().alias("open")))
    ways = followed(single, rounds)
    onto = ways.where("open").select(F.col("y").alias("node")).distinct()
    rings = rounds.kept(onto.join(ways, F.col("node") == F.col("x")).select("node", F.col("least").alias("component")))
    stay = starts.where("n > 1").select(F.col("a").alias("x"), F.col("a").alias("y"))
    ends = ways.where("NOT open").select("x", "y").join(stay.select(F.col("x").alias("y")), "y", "left_semi")
    entering = edges.join(stay.select(F.col("x").alias("a")), "a", "left_semi").join(stay.unionByName(ends), F.col("b") == F.col("x"))
    entering = rounds.kept(entering.select("a", "b", F.col("y").alias("end"), (F.col("x") != F.col("y")).alias("contracted")))
    rest = rounds.kept(entering.where("a != end").select(F.col("end").alias("a"), F.col("a").alias("b")).distinct())
    entries = entering.where("contracted").select(F.col("a").alias("w"), F.col("b").alias("s"))
    if entries.isEmpty():
        rounds.dropped(single, ways, entering, edges)
        return rest, rings, []
    path = rounds.kept(single.join(ends.select("x", F.col("y").alias("end")), "x").select("x", F.when(F.col("open"), F.col("y")).alias("y"), "end"), single, ways, edges)
    return rest, rings, [(entries, path)]


def _taken_back(labels: DataFrame, entries: DataFrame, path: DataFrame, rounds: Rounds) -> DataFrame:
    """labels with those of contracted nodes (path: x, the next one y, the end): whatever lies between a node w of the end's component and that end."""
    label = lambda of, name: labels.select(F.col("node").alias(of), F.col("component").alias(name))
    into = entries.join(path.select(F.col("x").alias("s"), "end"), "s").join(label("w", "cw"), "w", "left").join(label("end", "ce"), "end", "left")
    marked = rounds.kept(into.where(F.coalesce("cw", "w") == F.coalesce("ce", "end")).select(F.col("s").alias("x")).distinct())
    ways, size = path.where("y IS NOT NULL").select("x", "y"), marked.count()
    ways = rounds.kept(ways)
    while size:  # nodes after 1, 2, 4, ... steps from those that are marked
        more = rounds.kept(marked.unionByName(marked.join(ways, "x").select(F.col("y").alias("x"))).distinct(), marked)
        marked, before, size = more, size, more.count()
        if size == before:
            break
        ways = rounds.kept(ways.join(ways.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")), ways)
    of = marked.join(path, "x").join(label("end", "ce"), "end", "left").select("x", "end", F.coalesce("ce", "end").alias("component"))
    new = of.select(F.col("x").alias("node"), "component").unionByName(of.select(F.col("end").alias("node"), "component"))
    return rounds.kept(labels.unionByName(new).distinct())


def _coloured(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """The edges that are left; node, component of one component for each colour."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    colours = rounds.kept(ends.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")))
    while not colours.where("new").isEmpty():  # only what has changed is passed on
        passed = edges.join(colours.where("new").select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("c"))
        colours = rounds.kept(colours.join(passed, "node", "left").select("node", F.least("colour", "c").alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("new")), colours)
    of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"c{end}"))
    inside = rounds.kept(edges.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select("a", "b"), edges)
    reached = rounds.kept(colours.where("node = colour").select("node", F.col("colour").alias("component"), F.lit(True).alias("new")), colours)
    while not reached.where("new").isEmpty():
        back = inside.join(reached.where("new").select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component").distinct().join(reached.select("node"), "node", "left_anti")
        reached = rounds.kept(reached.withColumn("new", F.lit(False)).unionByName(back.withColumn("new", F.lit(True))), reached)
    got = reached.select("node", "component")
    gone = lambda end: reached.select(F.col("node").alias(end))
    return rounds.kept(inside.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b"), inside), got


def witnesses(edges: DataFrame) -> DataFrame:
    """component, position (from 0, at the cycle's least node), node: one cycle of each strong component of edges a, b.

    Every node of a component follows its least successor there; of the rings that this makes in a component, the one with
    the least node is its cycle.
    """
    with without_broadcasts(edges.sparkSession):
        return _witnesses(edges)


def _witnesses(edges: DataFrame) -> DataFrame:
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    parts = strong_components(edges)
    rounds = Rounds(edges.sparkSession, "witnesses")
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    inside = edges.join(of("a"), "a").join(of("b"), "b").where("ca = cb")
    next_ = rounds.kept(inside.groupBy(F.col("a").alias("x"), F.col("ca").alias("component")).agg(F.min("b").alias("y")))
    ways = followed(next_.select("x", "y", F.lit(True).alias("open")), rounds)
    rings = ways.select(F.col("y").alias("node")).distinct().join(ways, F.col("node") == F.col("x")).select("node", "least")
    rings = rings.join(next_, F.col("node") == F.col("x")).select("x", "y", "component", "least")
    first = rings.groupBy("component").agg(F.min("least").alias("least"))
    chosen = rounds.kept(rings.join(first, ["component", "least"]))
    ranked = followed(chosen.select("x", "y", (F.col("y") != F.col("least")).alias("open")), rounds)  # cut before the least node
    ranked = ranked.select("x", "steps").join(chosen, "x")
    length = ranked.where("x = least").select("component", F.col("steps").alias("length"))
    out = rounds.kept(ranked.join(length, "component").select("component", (F.col("length") - F.col("steps")).alias("position"), F.col("x").alias("node")))
    rounds.ended(out)
    return out
