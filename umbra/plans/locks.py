"""Queries of lock ordering; events of a user's session stand for acquires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import locks as L
from umbra.operators.cycles import strong_components
from umbra.sources.readers import table


def acquires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions (user, hundred of events) take locks (event type and value's parity) in order of event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("fn"), F.expr("event_id div 100").alias("seq"), F.col("event_id").alias("pos"), F.concat("event_type", F.col("event_id") % 2).alias("lock"))


def lock_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.order_edges(acquires(spark, sf_dir), "fn", "seq")


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' locks: rings of forty and chains of forty."""
    k = F.col("c_custkey")
    follows = F.when(k % 80 == 39, k - 39).when(k % 80 != 79, k + 1)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("L"), k).alias("a"), F.concat(F.lit("L"), follows).alias("b"))


def lock_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.on_cycles(sparse_edges(spark, sf_dir))


def lock_cycle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.cycle_reports(sparse_edges(spark, sf_dir))
    return r.select("lock", "length", F.array_join("cycle", " > ").alias("cycle"))


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows what on a user's day; each day has locks of its own."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    lock = F.concat_ws(":", F.col("user_id"), F.date_format("day", "yyyy-MM-dd"), F.col("event_type"))
    return L.order_edges(e.select("user_id", "day", F.struct("ts", "event_id").alias("pos"), lock.alias("lock")), "user_id", "day")


def lock_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(session_edges(spark, sf_dir))


def lock_with_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_pairs(acquires(spark, sf_dir), "fn", "seq")


def double_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.double_acquires(acquires(spark, sf_dir), "fn", "seq")


def inconsistent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events are a thread; for each thread how many later ones disagree with it."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.expr("event_id div 10").alias("thread")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("locks"))
    return L.inconsistent_counts(rows)


def proposed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("fn"), F.col("n_nationkey").alias("line"), F.col("n_name").alias("lock"))
    return L.proposed(n, "fn").select("fn", L.order_note(F.col("locks")).alias("note"))


def lock_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = lock_cycles(spark, sf_dir).select(F.lit("static_cycle").alias("type"), "node")
    return L.combined(cycles, cycles, L.double_acquires(acquires(spark, sf_dir), "fn", "seq").select(F.lit("double_acquire").alias("type"), F.col("lock").alias("node")))


def lock_order_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("fn"), F.col("n_nationkey").alias("line"), F.concat(F.lit("l"), "n_nationkey").alias("lock"))
    return L.proposed(n, "fn").select("fn", F.substring_index(L.order_wrapper(F.col("locks")), "\n", 1).alias("first"))


def lock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("import threading\nA"), F.col("n_nationkey"), F.lit(" = threading.Lock()\nB = threading.Lock()\ndef f():\n    with A"), F.col("n_nationkey"), F.lit(", B:\n        B.acquire()\n    with B.acquire():\n        pass\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(L.facts(code)).alias("f")).select("n_nationkey", "f.*")


QUERIES = {f.__name__: f for f in (lock_edges, lock_cycles, lock_cycle_reports, lock_components, lock_with_pairs, double_acquire, inconsistent_order, proposed_order, lock_order_code, lock_findings, lock_facts)}

ACQ = "q AS (SELECT user_id AS fn, event_id // 100 AS seq, event_id AS pos, event_type || (event_id % 2) AS lock FROM events)"
EDGES = "e AS (SELECT * FROM (SELECT 'L' || c_custkey AS a, 'L' || CASE WHEN c_custkey % 80 = 39 THEN c_custkey - 39 WHEN c_custkey % 80 <> 79 THEN c_custkey + 1 END AS b FROM customer) WHERE b IS NOT NULL)"
REACH = f"WITH RECURSIVE {EDGES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"
SQL = {
    "lock_edges": f"WITH {ACQ} SELECT DISTINCT a, b FROM (SELECT lock AS a, lead(lock) OVER (PARTITION BY fn, seq ORDER BY pos) AS b FROM q) WHERE b IS NOT NULL",
    "lock_cycles": f"{REACH} SELECT DISTINCT a AS node FROM r WHERE a = b",
    "lock_cycle_reports": f"WITH RECURSIVE {EDGES}, w(lock, here, n, way) AS (SELECT a, b, 1, a FROM e UNION ALL SELECT lock, e.b, n + 1, way || ' > ' || here FROM w JOIN e ON w.here = e.a WHERE here > lock) SELECT lock, CAST(n AS BIGINT) AS length, way || ' > ' || lock AS cycle FROM w WHERE here = lock",
    "lock_components": "WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) || ':' || event_type AS a, lead(user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) || ':' || event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "lock_with_pairs": f"WITH {ACQ} SELECT DISTINCT x.lock AS a, y.lock AS b FROM q x JOIN q y ON x.fn = y.fn AND x.seq = y.seq AND x.pos <> y.pos",
    "double_acquire": f"WITH {ACQ} SELECT fn, seq, pos, lock FROM (SELECT *, row_number() OVER (PARTITION BY fn, seq, lock ORDER BY pos) AS n FROM q) WHERE n > 1",
    "inconsistent_order": "WITH t AS (SELECT event_id // 10 AS thread, list(event_type ORDER BY event_id) AS locks FROM events GROUP BY 1) SELECT x.thread AS first, count(*) AS n FROM t x JOIN t y ON list_sort(list_distinct(x.locks)) = list_sort(list_distinct(y.locks)) AND x.thread < y.thread AND x.locks <> y.locks GROUP BY x.thread",
    "proposed_order": "SELECT n_regionkey AS fn, '# acquire in this order: ' || string_agg(n_name, ', ' ORDER BY n_nationkey, n_name) AS note FROM nation GROUP BY n_regionkey",
    "lock_order_code": "SELECT n_regionkey AS fn, 'LOCK_ORDER = [' || string_agg(chr(39) || 'l' || n_nationkey || chr(39), ', ' ORDER BY n_nationkey) || ']' AS first FROM nation GROUP BY n_regionkey",
    "lock_facts": "SELECT n_nationkey, kind, fn, seq, pos, replace(lock, 'A', 'A' || n_nationkey) AS lock FROM nation, (VALUES ('def', '<module>', 0, 2, 'A'), ('def', '<module>', 0, 3, 'B'), ('acquire', 'f', 0, 0, 'A'), ('acquire', 'f', 0, 1, 'B'), ('acquire', 'f', 0, 2, 'B'), ('acquire', 'f', 0, 3, 'B'), ('acquire', 'f', 0, 4, 'B'), ('with', 'f', 1, 0, 'A'), ('with', 'f', 1, 1, 'B')) v(kind, fn, seq, pos, lock)",
    "lock_findings": f"{REACH}, {ACQ} SELECT DISTINCT '{{\"node\":\"' || a || '\",\"type\":\"static_cycle\"}}' AS finding FROM r WHERE a = b UNION SELECT '{{\"node\":\"' || lock || '\",\"type\":\"double_acquire\"}}' FROM (SELECT *, row_number() OVER (PARTITION BY fn, seq, lock ORDER BY pos) AS n FROM q) WHERE n > 1",
}
