"""Queries of findings: parsers, deduplication, roll-ups, file discovery and fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import findings as G
from umbra.operators.answers import first_errors
from umbra.plans.privacy import LANGUAGE8_SQL, snippets
from umbra.sources.files import Files
from umbra.sources.folders import shared_folder
from umbra.sources.readers import discovered, shown, spread, table

#: Report lines built from parts, of each tool; one expression for both engines.
REPORTS = {
    "flake8": "concat('src/p', CAST(p_partkey % 50 AS STRING), '.py:', CAST(p_partkey AS STRING), ':', CAST(p_size AS STRING), ': ', CASE WHEN p_partkey % 3 = 0 THEN 'W291' ELSE 'E501' END, ' ', p_name, chr(10), 'not a finding', chr(10), 'a.py:1:2: F401 unused')",
    "mypy": "concat('src/p', CAST(p_partkey % 50 AS STRING), '.py:', CAST(p_partkey AS STRING), ': ', CAST(p_size AS STRING), ': ', CASE WHEN p_partkey % 4 = 0 THEN 'note' ELSE 'error' END, ': ', p_name)",
    "tsc": "concat('src/p', CAST(p_partkey % 50 AS STRING), '.ts(', CAST(p_partkey AS STRING), ',', CAST(p_size AS STRING), '): ', CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'error' END, ' TS', CAST(1000 + p_size AS STRING), ': ', p_name)",
    "javac": "concat('P', CAST(p_partkey AS STRING), '.java:', CAST(p_size AS STRING), ': ', CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'error' END, ': ', CASE WHEN p_partkey % 6 = 0 THEN 'an error of ' ELSE '' END, p_name)",
    "clang-tidy": "concat('p.cpp:', CAST(p_partkey AS STRING), ':', CAST(p_size AS STRING), ': ', CASE p_partkey % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' ELSE 'note' END, ': ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' [bugprone]' ELSE '' END)",
    "go vet": "concat('p.go:', CAST(p_partkey AS STRING), ': ', CASE WHEN p_partkey % 2 = 0 THEN '7: ' ELSE '' END, p_name)",
    "cargo": "concat('p.rs:', CAST(p_partkey AS STRING), ':', CAST(p_size AS STRING), ': ', CASE WHEN p_partkey % 2 = 0 THEN 'error' ELSE 'warning' END, ': ', p_name)",
    "generic": "concat('p.x:', CAST(p_partkey AS STRING), ':', CASE WHEN p_partkey % 2 = 0 THEN '4:' ELSE '' END, ' ', p_name)",
}


def _shown(found: DataFrame) -> DataFrame:
    """A finding's columns; a line or column that the report doesn't name is -1."""
    return found.select("p_partkey", "ordinal", "id", "tool", "severity", "message", "file", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("line", "column")], "suggestion")


def report(tool: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(REPORTS[tool]).alias("report"))
        return _shown(G.parsed(rows, tool, "report", "p_partkey"))

    return run


def _report_sql(tool: str) -> str:
    pattern = G.LINES[tool].replace("'", "''")
    g = lambda i: f"regexp_extract(raw, '{pattern}', {i})"
    message, column, level = G.READ[tool]
    low = f"lower({g(level)})"
    two = "CASE WHEN {} THEN 'error' ELSE 'warning' END"
    severity = {"flake8": f"CASE WHEN starts_with({g(4)}, 'W') THEN 'warning' ELSE 'error' END", "mypy": "'error'", "tsc": two.format(f"{low} = 'error'"), "javac": two.format("contains(lower(raw), 'error')"), "clang-tidy": f"CASE {low} WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END", "go vet": "'warning'", "cargo": two.format(f"{low} = 'error'"), "generic": "'warning'"}[tool]
    name = {"flake8": f"'flake8:' || {g(4)}", "mypy": "'mypy:type'", "tsc": f"'tsc:' || {g(5)}", "javac": "'javac'", "clang-tidy": f"'clang-tidy:' || CASE WHEN coalesce({g(6)}, '') = '' THEN 'unknown' ELSE {g(6)} END", "go vet": "'govet'", "cargo": f"'cargo:' || {severity}", "generic": "'generic:generic'"}[tool]
    suggestion = G.SUGGESTIONS.get(tool)
    return f"""WITH t AS (SELECT p_partkey, string_split({REPORTS[tool]}, chr(10)) AS rows FROM part),
l AS (SELECT p_partkey, i AS ordinal, trim(rows[i + 1]) AS raw FROM (SELECT *, unnest(range(len(rows))) AS i FROM t))
SELECT p_partkey, ordinal, {name} AS id, '{tool}' AS tool, {severity} AS severity, {g(message)} AS message, trim({g(1)}) AS file,
 coalesce(TRY_CAST({g(2)} AS INT), -1) AS line, {f"coalesce(TRY_CAST({g(column)} AS INT), -1)" if column else "-1"} AS "column", {f"'{suggestion}'" if suggestion else "CAST(NULL AS VARCHAR)"} AS suggestion
FROM l WHERE regexp_matches(raw, '{pattern}')"""


BANDIT = """concat('{"results": [{"filename": "p', CAST(p_partkey AS STRING), '.py", "line_number": ', CAST(p_size AS STRING), ', "issue_severity": "', CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END, '", "test_id": "B', CAST(100 + p_size AS STRING), '", "issue_text": "', p_name, '"}, {"filename": "q.py", "issue_confidence": "LOW"}]', CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '}' END)"""
ESLINT = """concat('[{"filePath": "p', CAST(p_partkey AS STRING), '.js", "messages": [{"ruleId": "semi", "severity": ', CAST(p_partkey % 3 AS STRING), ', "message": "', p_name, '", "line": ', CAST(p_size AS STRING), ', "column": 7}, {"severity": 2, "message": "parse"}]}]')"""


def parse_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(G.parsed_bandit(table(spark, sf_dir, "part").select("p_partkey", F.expr(BANDIT).alias("report")), "report", "p_partkey"))


def parse_eslint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(G.parsed_eslint(table(spark, sf_dir, "part").select("p_partkey", F.expr(ESLINT).alias("report")), "report", "p_partkey"))


def parse_json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON props of events, as many as parse; safe numbers."""
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("p"), "props")
    return rows.select("event_id", F.col("p").isNotNull().alias("parsed"), F.size(F.coalesce(F.json_object_keys("props"), F.array())).alias("keys"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: many alike for each user."""
    severity = F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END")
    null = F.lit(None)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("tool"), severity.alias("severity"), F.expr("concat('m', CAST(event_id % 3 AS STRING))").alias("message"), null.cast("string").alias("file"), F.expr("CAST(event_id % 5 AS INT)").alias("line"), null.cast("int").alias("column"))


def findings_dedupe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.capped(_findings(spark, sf_dir), cap=20).select("path", "ordinal", "tool", "severity", "message", "line")


def findings_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(G.capped(_findings(spark, sf_dir)), "path")


def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.overall(G.summary(G.capped(_findings(spark, sf_dir)), "path"))


def findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of labelled documents by language, with totals."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", F.when(F.col("toxic") > 0, "error").when(F.col("quality") == 0, "warning").otherwise("info").alias("severity"))
    return rows.rollup("lang", "severity").agg(F.count("*").alias("n"))


def heuristic_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("run "), F.when(F.col("p_partkey") % 3 == 0, "exec(").when(F.col("p_partkey") % 3 == 1, "executor(").otherwise("popen "), "p_name").alias("code"))
    return rows.where(F.col("code").rlike(G.DANGEROUS)).select("p_partkey", F.lit("warning").alias("severity"))


def discover_files_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('/repo/', CASE o_orderkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/unit/' ELSE '' END, 'f', CAST(o_orderkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.txt' WHEN 3 THEN '.JS' ELSE '' END)").alias("path"))
    return discovered(paths, "/repo", ["src/*", "*.py", "tests/*"], ["tests/*.go"]).select("o_orderkey", "path", "language")


def autofix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr(AUTOFIX)
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", G.fixed_python(made).alias("fixed"))


AUTOFIX = """concat('class A:', chr(10), '    def _init_(self):', chr(10), '        try:', chr(10), '            r = requests.get("http://x/', CAST(p_partkey AS STRING), '"', CASE WHEN p_partkey % 2 = 0 THEN ', timeout=3' ELSE '' END, ')', chr(10), '        except:', chr(10), '            requests.post(u)')"""


def autofix_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr(AUTOFIX)
    return G.diffs(spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", made.alias("before"), G.fixed_python(made).alias("after")), "p_partkey")


def ast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the syntax tree of generated Python says, and of every seventh piece that it can't be parsed."""
    code = F.concat(F.expr(AUTOFIX.replace("requests.post(u)", "eval(u)")), F.when(F.col("p_partkey") % 7 == 0, "\n(").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), code.alias("content"))
    return _shown(G.ast_findings(rows, "p_partkey")).withColumn("file", F.coalesce("file", F.lit("-")))


def validated_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets by the checks of their language."""
    rows = snippets(spark, sf_dir).select(F.concat_ws("/", F.col("id").cast("string"), "path").alias("path"), F.col("code").alias("content"))
    return G.validated(rows).select("path", "language", "errors", "warnings", "info", "status", F.size("findings").alias("findings"))


def validated_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each part, by its syntax tree and by what a linter says of it; every fifth has no report, every seventh is no Python."""
    name, code = F.concat(F.lit("src/q"), "p_partkey", F.lit(".py")), F.expr(VALIDATED)
    parts = table(spark, sf_dir, "part")
    reports = parts.where("p_partkey % 5 > 0").select(name.alias("path"), F.lit("flake8").alias("tool"), F.expr(REPORTS["flake8"]).alias("stdout"))
    out = G.validated(parts.select(name.alias("path"), code.alias("content")), reports)
    said = F.array_join(F.transform("findings", lambda f: F.concat(f["id"], F.lit("@"), F.coalesce(f["line"].cast("string"), F.lit("-")))), " ")
    return out.select("path", "language", "errors", "warnings", "info", "status", said.alias("said"))


VALIDATED = "concat('def size():', chr(10), CASE WHEN p_size % 2 = 0 THEN '    return eval(name)' ELSE '    return 1' END, CASE WHEN p_partkey % 7 = 0 THEN ' (' ELSE '' END)"


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tools in one form, also those that gave nothing usable."""
    k = F.col("p_partkey")
    result = F.when(k % 7 != 0, F.struct(F.when(k % 5 != 0, F.col("p_name")).alias("stdout"), F.lit(None).cast("string").alias("stderr"), F.when(k % 3 != 0, F.col("p_size")).alias("exit_code"), F.when(k % 2 == 0, F.lit(9)).alias("returncode")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("flake8").alias("tool"), result.alias("result"))
    return G.tool_results(rows, "p_partkey").withColumn("diagnostics", F.coalesce("diagnostics", F.lit("-")))


def error_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each user's findings."""
    return first_errors(_findings(spark, sf_dir), "path")


def tool_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(G.truncated(F.col("text"), 500)).alias("n"), F.right(G.truncated(F.col("text"), 500), F.lit(3)).alias("end"))


def byte_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, also those where bytes aren't characters."""
    return table(spark, sf_dir, "documents").select("doc_id", G.truncated_bytes(F.col("text"), 300).alias("cut"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    language = F.expr("element_at(array('c', 'python', 'rust', 'go'), int(o_orderkey % 4) + 1)")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.run_status(k % 11 == 0, k % 7 == 0, F.when(k % 5 != 0, k % 3), language, F.when(k % 2 == 0, "Error: x").otherwise("")).alias("status"))


UNION = {0: "flake8", 1: "mypy", 2: "cargo", 3: "clang-tidy"}


def findings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several tools in one table."""
    k = F.col("p_partkey") % 4
    tool, text = F.lit("other"), F.lit("")
    for i, t in UNION.items():
        tool, text = F.when(k == i, t).otherwise(tool), F.when(k == i, F.expr(REPORTS[t])).otherwise(text)
    return _shown(G.parsed_all(table(spark, sf_dir, "part").select("p_partkey", tool.alias("tool"), text.alias("stdout")), "p_partkey"))


def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, their orders as findings."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    null = F.lit(None)
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("ordinal"), F.lit("t").alias("tool"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END").alias("severity"), F.col("o_orderpriority").alias("message"), null.cast("string").alias("file"), null.cast("int").alias("line"), null.cast("int").alias("column"))
    return G.file_reports(files, found).select("path", "errors", "warnings", "info", "status")


SCAN = "concat('f', CAST(c_custkey AS STRING), CASE c_custkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.csv' WHEN 2 THEN '.py' ELSE '' END)"


def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a file is shown: bytes, a header, or its text."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(SCAN).alias("path"), F.concat("c_name", F.lit("\nrow")).cast("binary").alias("content"))
    return rows.select("c_custkey", shown(F.col("path"), F.col("content")).alias("s")).select("c_custkey", "s.kind", "s.body")


def dataset_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be shown of a folder of data sets, a file for each nation's customers: of each its first line and no more."""
    at = shared_folder(spark, "headers")
    rows = table(spark, sf_dir, "customer").repartition("c_nationkey").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows.write.partitionBy("nation").option("header", True).csv(at)
    spark.dataSource.register(Files)
    found = spark.read.format("umbra_files").option("include", "*.csv").load(at)
    return found.select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("int").alias("nation"), "kind", "body").distinct()


QUERIES = {f"parse_{t.replace('-', '_').replace(' ', '_')}": report(t) for t in REPORTS} | {
    "dataset_headers": dataset_headers,
    "parse_bandit": parse_bandit,
    "parse_eslint": parse_eslint,
    "parse_json_findings": parse_json_findings,
    "findings_dedupe_cap": findings_dedupe_cap,
    "findings_status": findings_status,
    "findings_rollup": findings_rollup,
    "findings_by_language": findings_by_language,
    "heuristic_exec": heuristic_exec,
    "discover_files_glob": discover_files_glob,
    "autofix_rules": autofix_rules,
    "autofix_diff": autofix_diff,
    "ast_checks": ast_checks,
    "validated_snippets": validated_snippets,
    "validated_with_tools": validated_with_tools,
    "tool_results": tool_results,
    "error_findings": error_findings,
    "tool_truncated": tool_truncated,
    "byte_truncated": byte_truncated,
    "run_status": run_status,
    "findings_union": findings_union,
    "file_reports": file_reports,
    "typed_scan": typed_scan,
}

CAPPED = """WITH f AS (SELECT user_id AS path, event_id AS ordinal, event_type AS tool, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, 'm' || (event_id % 3) AS message, CAST(event_id % 5 AS INT) AS line FROM events),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY path, tool, message, line ORDER BY ordinal) = 1),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY ordinal) <= {cap}),
s AS (SELECT path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info FROM c GROUP BY path)"""


def _diff_sql(*lines: str) -> str:
    """Lines of a diff, that end in a line end of their own, as SQL; {k} is the part's key."""
    whole = "--- original\n+++ suggested\n@@ -1,6 +1,6 @@\n" + "\n".join(lines)
    return " || chr(10) || ".join("'" + x.replace("{k}", "' || p_partkey || '") + "'" for x in whole.split("\n"))


_SAME, _NAMED = (" class A:\n", "-    def _init_(self):\n", "+    def __init__(self):\n", "         try:\n"), ("+        except Exception as e:\n", "+            requests.post(u, timeout=10)")
DIFF = f"""CASE WHEN p_partkey % 2 = 0 THEN {_diff_sql(*_SAME, '             r = requests.get("http://x/{k}", timeout=3)' + chr(10), "-        except:" + chr(10), "-            requests.post(u)", *_NAMED)}
 ELSE {_diff_sql(*_SAME, '-            r = requests.get("http://x/{k}")' + chr(10), "-        except:" + chr(10), "-            requests.post(u)", '+            r = requests.get("http://x/{k}", timeout=10)' + chr(10), *_NAMED)} END"""

SQL = {f"parse_{t.replace('-', '_').replace(' ', '_')}": _report_sql(t) for t in REPORTS} | {
    "dataset_headers": "SELECT DISTINCT c_nationkey AS nation, 'schema' AS kind, 'id,name' AS body FROM customer",
    "parse_bandit": f"""WITH t AS (SELECT p_partkey, {BANDIT} AS j FROM part), r AS (SELECT p_partkey, i AS ordinal, json_extract(j, '$.results[' || i || ']') AS r FROM (SELECT *, unnest([0, 1]) AS i FROM t WHERE json_valid(j)))
SELECT p_partkey, CAST(ordinal AS BIGINT) AS ordinal, 'bandit:' || coalesce(r ->> 'test_id', 'unknown') AS id, 'bandit' AS tool, CASE lower(coalesce(r ->> 'issue_severity', '')) WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS severity,
 coalesce(r ->> 'issue_text', r ->> 'issue_confidence', '') AS message, r ->> 'filename' AS file, coalesce(TRY_CAST(r ->> 'line_number' AS INT), -1) AS line, -1 AS "column", CAST(NULL AS VARCHAR) AS suggestion FROM r""",
    "parse_eslint": f"""WITH t AS (SELECT p_partkey, {ESLINT} AS j FROM part), r AS (SELECT p_partkey, i AS ordinal, j ->> '$[0].filePath' AS file, json_extract(j, '$[0].messages[' || i || ']') AS r FROM (SELECT *, unnest([0, 1]) AS i FROM t))
SELECT p_partkey, CAST(ordinal AS BIGINT) AS ordinal, 'eslint:' || coalesce(r ->> 'ruleId', 'unknown') AS id, 'eslint' AS tool, CASE WHEN CAST(r ->> 'severity' AS INT) = 2 THEN 'error' ELSE 'warning' END AS severity,
 r ->> 'message' AS message, file, coalesce(TRY_CAST(r ->> 'line' AS INT), -1) AS line, coalesce(TRY_CAST(r ->> 'column' AS INT), -1) AS "column", CAST(NULL AS VARCHAR) AS suggestion FROM r""",
    "parse_json_findings": "SELECT event_id, json_valid(props) AS parsed, CASE WHEN json_valid(props) THEN len(json_keys(props)) ELSE 0 END AS keys FROM events",
    "findings_dedupe_cap": CAPPED.format(cap=20) + " SELECT path, ordinal, tool, severity, message, line FROM c",
    "findings_status": CAPPED.format(cap=1000) + " SELECT path, errors, warnings, info, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'partial' ELSE 'ok' END AS status FROM s",
    "findings_rollup": CAPPED.format(cap=1000) + " SELECT CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum(info) AS BIGINT) AS info, count(*) AS files_validated FROM s",
    "findings_by_language": "SELECT lang, CASE WHEN toxic > 0 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, CASE WHEN toxic > 0 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END)",
    "heuristic_exec": r"SELECT p_partkey, 'warning' AS severity FROM (SELECT p_partkey, 'run ' || CASE p_partkey % 3 WHEN 0 THEN 'exec(' WHEN 1 THEN 'executor(' ELSE 'popen ' END || p_name AS code FROM part) WHERE regexp_matches(code, '\b(eval|exec|system|popen|ProcessBuilder)\b')",
    "discover_files_glob": "WITH p AS (SELECT o_orderkey, concat('/repo/', CASE o_orderkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/unit/' ELSE '' END, 'f', CAST(o_orderkey AS VARCHAR), CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.txt' WHEN 3 THEN '.JS' ELSE '' END) AS path FROM orders), r AS (SELECT *, substr(path, 7) AS rel FROM p) SELECT o_orderkey, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' ELSE 'javascript' END AS language FROM r WHERE (rel LIKE 'src/%' OR rel LIKE '%.py' OR rel LIKE 'tests/%') AND NOT rel LIKE 'tests/%.go' AND (path LIKE '%.py' OR path LIKE '%.go' OR lower(path) LIKE '%.js')",
    "autofix_rules": f"SELECT p_partkey, replace(replace(replace({AUTOFIX}, '_init_', '__init__'), 'except:', 'except Exception as e:'), 'requests.post(u)', 'requests.post(u, timeout=10)').replace(CAST(p_partkey AS VARCHAR) || '\")', CAST(p_partkey AS VARCHAR) || '\", timeout=10)') AS fixed FROM part",
    "tool_truncated": "SELECT doc_id, CASE WHEN length(text) > 500 THEN 503 ELSE length(text) END AS n, CASE WHEN length(text) > 500 THEN '...' ELSE right(text, 3) END AS \"end\" FROM documents",
    "byte_truncated": "WITH k AS (SELECT doc_id, text, left(text, len(list_filter(range(1, 301), lambda i: strlen(left(text, i)) <= 300))) AS part FROM documents) SELECT doc_id, CASE WHEN strlen(text) > 300 THEN part || CASE WHEN strlen(part) < 300 THEN chr(65533) ELSE '' END || chr(10) || '...[truncated]' ELSE text END AS cut FROM k",
    "autofix_diff": f"SELECT p_partkey, {DIFF} AS diff FROM part",
    "ast_checks": f"""SELECT p_partkey, ordinal, id, 'ast' AS tool, severity, message, file, line, "column", suggestion FROM (
 SELECT p_partkey, CAST(0 AS BIGINT) AS ordinal, 'ast:bare-except' AS id, 'warning' AS severity, 'Bare except detected (catching all exceptions).' AS message, 'p' || p_partkey || '.py' AS file, 5 AS line, -1 AS "column", 'Catch specific exceptions or use `except Exception as e`.' AS suggestion FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT p_partkey, 1, 'ast:insecure-eval', 'error', 'Use of eval() is insecure.', 'p' || p_partkey || '.py', 6, -1, 'Avoid eval/exec; validate inputs and avoid dynamic execution.' FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT p_partkey, 0, 'ast:syntax', 'error', 'SyntaxError: ''('' was never closed', '<unknown>', 7, 1, 'Fix syntax error.' FROM part WHERE p_partkey % 7 = 0)""",
    "validated_snippets": f"SELECT id || '/' || path AS path, language, CAST(e AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS info, CASE WHEN e = 1 THEN 'error' ELSE 'ok' END AS status, e AS findings FROM (SELECT *, CASE WHEN language = 'python' AND id % 12 IN (1, 2, 3, 5, 6, 7, 10, 11) THEN 1 ELSE 0 END AS e FROM ({LANGUAGE8_SQL}))",
    "validated_with_tools": """WITH f AS (
 SELECT p_partkey AS k, 0 AS n, CASE WHEN p_partkey % 7 = 0 THEN 'ast:syntax' ELSE 'ast:insecure-eval' END AS id, 'error' AS severity, 2 AS line FROM part WHERE p_partkey % 7 = 0 OR p_size % 2 = 0
 UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 3 = 0 THEN 'flake8:W291' ELSE 'flake8:E501' END, CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'error' END, p_partkey FROM part WHERE p_partkey % 5 > 0
 UNION ALL SELECT p_partkey, 2, 'flake8:F401', 'error', 1 FROM part WHERE p_partkey % 5 > 0),
 g AS (SELECT k, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, string_agg(id || '@' || line, ' ' ORDER BY n) AS said FROM f GROUP BY k)
 SELECT 'src/q' || p_partkey || '.py' AS path, 'python' AS language, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CAST(0 AS BIGINT) AS info,
 CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'partial' ELSE 'ok' END AS status, coalesce(said, '') AS said FROM part LEFT JOIN g ON p_partkey = k""",
    "tool_results": "SELECT p_partkey, 'flake8' AS tool, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN '' ELSE p_name END AS stdout, CASE WHEN p_partkey % 7 = 0 THEN 'Invalid sandbox result type for flake8' ELSE '' END AS stderr, CASE WHEN p_partkey % 7 = 0 THEN -1 WHEN p_partkey % 3 <> 0 THEN p_size WHEN p_partkey % 2 = 0 THEN 9 ELSE 0 END AS exit_code, CASE WHEN p_partkey % 7 = 0 THEN 'invalid-result-type' ELSE '-' END AS diagnostics FROM part",
    "error_findings": CAPPED.format(cap=1000) + " SELECT path, arg_min(message, ordinal) AS message FROM f WHERE severity = 'error' GROUP BY path",
    "findings_union": " UNION ALL ".join(f"SELECT * FROM ({_report_sql(t)}) WHERE p_partkey % 4 = {i}" for i, t in UNION.items()),
    "file_reports": "WITH f AS (SELECT o_custkey, o_orderpriority AS m, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1, 2), n AS (SELECT o_custkey, count(*) FILTER (s = 'F') AS errors, count(*) FILTER (s = 'O') AS warnings, count(*) FILTER (s NOT IN ('F', 'O')) AS info FROM f GROUP BY 1) SELECT c_custkey AS path, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(info, 0) AS info, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'partial' ELSE 'ok' END AS status FROM customer LEFT JOIN n ON c_custkey = o_custkey",
    "typed_scan": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'schema' ELSE 'text' END AS kind, CASE c_custkey % 4 WHEN 0 THEN base64(encode(c_name || chr(10) || 'row')) WHEN 1 THEN c_name ELSE c_name || chr(10) || 'row' END AS body FROM customer",
    "run_status": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'timeout' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'sandbox_error' WHEN o_orderkey % 3 = 0 THEN 'success' WHEN o_orderkey % 4 IN (0, 2) AND o_orderkey % 2 = 0 THEN 'compile_error' ELSE 'test_failure' END AS status FROM orders",
}
