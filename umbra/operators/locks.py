"""Lock ordering as a graph: facts from code, order edges, cycles, double and inconsistent acquires."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.operators.cycles import strong_components, witnesses


def lock_facts(code: str | None) -> list[tuple[str, str, int, int, str]]:
    """kind (def, acquire or with), function, sequence, position (or line), lock of Python code; none if it can't be parsed.

    A function's sequence is what it takes, functions inside it included: each name of a with statement, or whose method
    a with statement calls, and each name that is acquired (`with a.acquire()` takes a twice). Statements that take
    several names at once are numbered.
    """
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return []

    def named(node: ast.With) -> list[str]:
        of = [i.context_expr for i in node.items]
        return [x.id if isinstance(x, ast.Name) else x.func.value.id for x in of if isinstance(x, ast.Name) or (isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name))]

    def taken(node: ast.AST) -> Iterator[str]:
        if isinstance(node, ast.With):
            yield from named(node)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "acquire" and isinstance(node.func.value, ast.Name):
            yield node.func.value.id
        for child in ast.iter_child_nodes(node):
            yield from taken(child)

    out: list[tuple[str, str, int, int, str]] = []
    sequences: dict[str, int] = {}
    statements = 0

    def walk(node: ast.AST, fn: str) -> None:
        nonlocal statements
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and getattr(node.value.func, "attr", getattr(node.value.func, "id", "")) == "Lock":
            out.extend(("def", fn, 0, node.lineno, t.id) for t in node.targets if isinstance(t, ast.Name))
        if isinstance(node, ast.With) and len(names := named(node)) > 1:
            statements += 1
            out.extend(("with", fn, statements, i, name) for i, name in enumerate(names))
        if isinstance(node, ast.FunctionDef):
            fn = node.name
            if names := list(taken(node)):
                n = sequences[fn] = sequences.get(fn, -1) + 1
                out.extend(("acquire", fn, n, i, name) for i, name in enumerate(names))
        for child in ast.iter_child_nodes(node):
            walk(child, fn)

    walk(tree, "<module>")
    return out


def _facts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([lock_facts(c) for c in batch])


def facts(code: Column) -> Column:
    return F.pandas_udf(_facts, "array<struct<kind:string,fn:string,seq:int,pos:int,lock:string>>")(code)


def order_edges(acquires: DataFrame, *by: str) -> DataFrame:
    """a, b: locks acquired one after the other within a sequence (columns by, pos, lock)."""
    after = F.expr(f"lead(lock) OVER (PARTITION BY {', '.join(by)} ORDER BY pos)")
    return acquires.select(F.col("lock").alias("a"), after.alias("b")).where("b IS NOT NULL").distinct()


def with_pairs(sites: DataFrame, *by: str) -> DataFrame:
    """Both directions of every two locks that one statement takes."""
    once = sites.groupBy(*by, "lock").agg(F.min("pos").alias("least"), F.max("pos").alias("greatest"))
    x = once.select(*by, F.col("least").alias("p"), F.col("lock").alias("a"))
    y = once.select(*by, F.col("greatest").alias("q"), F.col("lock").alias("b"))
    pairs = x.join(y, list(by)).where("p < q").select("a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def on_cycles(edges: DataFrame) -> DataFrame:
    """The locks (node) from which a way of edges (a, b) leads back."""
    return strong_components(edges).select("node")


def cycle_reports(edges: DataFrame, most: int = 1000) -> DataFrame:
    """lock (its component's least), length, cycle: the locks of one cycle of each component, the first again at the end.

    A cycle of more than `most` locks is told by its first ones and its length, so no row grows with the graph; witnesses()
    has all of it, a row for each lock.
    """
    steps = witnesses(edges)
    first = F.collect_list(F.when(F.col("position") < most, F.struct("position", "node")))
    shown = steps.groupBy("component").agg(F.count("*").alias("length"), F.transform(F.array_sort(first), lambda x: x["node"]).alias("locks"))
    whole = F.concat("locks", F.when(F.col("length") <= most, F.slice("locks", 1, 1)).otherwise(F.slice("locks", 1, 0)))
    return shown.select(F.col("component").alias("lock"), "length", whole.alias("cycle"))


def double_acquires(acquires: DataFrame, *by: str) -> DataFrame:
    """Every acquire of a lock that its sequence has acquired before."""
    n = F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)}, lock ORDER BY pos)")
    return acquires.withColumn("n", n).where("n > 1").drop("n")


def inconsistent_counts(orders: DataFrame, thread: str = "thread", locks: str = "locks") -> DataFrame:
    """first, n: how many greater threads (integers) took the same set of locks in another order, counted without the pairs.

    Those of the same set less those of the same order; of a group, the greater ones are those of later buckets of
    threads and the greater ones of the own bucket.
    """
    rows = orders.select(F.col(thread).alias("t"), F.col(locks).alias("l"), F.array_sort(F.array_distinct(locks)).alias("s")).withColumn("b", F.expr("t div 1024"))

    def greater(rows: DataFrame, of: str, name: str) -> DataFrame:
        sizes = rows.groupBy(of, "b").agg(F.count("*").alias("c"))
        later = sizes.select(F.col(of).alias("g"), F.col("b").alias("at"), F.expr(f"coalesce(sum(c) OVER (PARTITION BY {of} ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("later"))
        own = rows.withColumn("own", F.expr(f"rank() OVER (PARTITION BY {of}, b ORDER BY t DESC) - 1"))
        return own.join(later, (F.col(of) == F.col("g")) & (F.col("b") == F.col("at"))).withColumn(name, F.col("own") + F.col("later")).drop("g", "at", "own", "later")

    both = greater(greater(rows, "s", "alike"), "l", "equal")
    return both.groupBy(F.col("t").alias("first")).agg(F.sum(F.col("alike") - F.col("equal")).alias("n")).where("n > 0")


def proposed(defs: DataFrame, *by: str) -> DataFrame:
    """The locks in order of their declaration."""
    rows = defs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line", "lock"))).alias("l"))
    return rows.select(*by, F.transform("l", lambda x: x["lock"]).alias("locks"))


def combined(*findings: DataFrame) -> DataFrame:
    """All findings as JSON, each once."""
    rows = [f.select(F.to_json(F.struct(*sorted(f.columns))).alias("finding")) for f in findings]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def order_wrapper(locks: Column) -> Column:
    """Python code that takes locks in their order (array<string>), an example to go with the advice; null without locks."""
    names = F.concat(F.lit("["), F.array_join(F.transform(locks, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    body = "\n\n\ndef take(**held):\n    for name in LOCK_ORDER:\n        if name in held:\n            held[name].acquire()\n\n\ndef give_back(**held):\n    for name in reversed(LOCK_ORDER):\n        if name in held:\n            held[name].release()\n"
    return F.when(F.size(locks) > 0, F.concat(F.lit("LOCK_ORDER = "), names, F.lit(body)))


def order_note(locks: Column) -> Column:
    return F.concat(F.lit("# acquire in this order: "), F.array_join(locks, ", "))
