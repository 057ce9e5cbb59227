"""Queries of prompt assembly and of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import answers as N
from umbra.operators import text as T
from umbra.sources.readers import table

#: Files of a project: the orders of a customer; one expression for both engines.
PATH = "concat(CASE o_orderkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'a/b/' ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'app' WHEN 2 THEN 'util' WHEN 3 THEN 'index' ELSE 'x' END, CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.kt' WHEN 3 THEN '.zig' WHEN 4 THEN '.md' ELSE '' END)"
CONTENT = "concat('code ', o_orderpriority, ' ``` ', CAST(o_orderkey AS STRING))"
ANSWER = """concat('Here:', chr(10), '```', CASE conv_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN '' ELSE 'js' END, chr(10), text, chr(10), '```', chr(10), CASE WHEN turn % 2 = 0 THEN concat('<analysis> n', CAST(conv_id AS STRING), ' </analysis> after ') ELSE '' END, '```', chr(10), 'sh', chr(10), 'ls', chr(10), '```')"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"), "o_orderkey")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(ANSWER).alias("answer"))


def fence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", T.fence_language(F.col("path")).alias("language"))


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.joined(files(spark, sf_dir), "project").select("project", "tree")


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.joined(files(spark, sf_dir), "project", most=12, order="o_orderkey").select("project", "blocks")


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.joined(files(spark, sf_dir), "project")
    return rows.select("project", F.md5(T.prompt("multi_file_task", task=F.concat(F.lit("t"), F.col("project")), tree=F.col("tree"), blocks=F.col("blocks")).cast("binary")).alias("prompt"))


def prompt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other templates over one customer's columns."""
    c = {k: F.col("c_name") for k in ("target", "framework", "tree", "blocks", "request", "language", "context", "error", "instruction", "reply", "path", "code", "strict", "task", "log", "analysis", "verification")}
    names = [n for n in T.TEMPLATES if n != "multi_file_task"]
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.md5(T.prompt(n, **c).cast("binary")).alias(n) for n in names])


def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clipped(F.col("text"), 200).cast("binary")).alias("cut"))


def normalise_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalised(F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('a', chr(13), chr(10), c_name, chr(13), 'b', CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE '' END) END")).alias("code"))


def fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.fenced(F.col("answer"))).alias("k", "b"))
    return rows.select("conv_id", "turn", "k", F.coalesce("b.language", F.lit("")).alias("language"), F.md5(F.col("b.code").cast("binary")).alias("code"))


def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", F.md5(T.extracted_code(F.col("answer")).cast("binary")).alias("code"))


def analysis_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("conv_id", "turn", T.analysis(F.col("answer")).alias("a"))
    return rows.select("conv_id", "turn", F.coalesce("a.analysis", F.lit("")).alias("analysis"), F.length("a.rest").alias("rest"))


def scrub_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.scrubbed(F.concat(F.lit("x = <<STRING_ab12>> <<COMMENT_0f>>"), "c_name")).alias("text"))


def main_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.main_file(files(spark, sf_dir), "project")


def main_test_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.main_file(files(spark, sf_dir), "project", prefer_test=True)


def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = c.where("c_custkey % 3 != 0").select("c_custkey", F.col("c_name").alias("content"))
    b = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("content"))
    return T.overlaid(a, b, "c_custkey")


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sized(table(spark, sf_dir, "documents"), "source", content="text", most=30_000)


def format_multifile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.marked_files(files(spark, sf_dir), "project").select("project", F.md5(F.col("text").cast("binary")).alias("text"))


def json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in lines that hold some, in a fence, in a sentence or bare."""
    line = F.expr("CASE event_id % 3 WHEN 0 THEN concat('so: ', props, ' and so on') WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') ELSE props END")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(N.found_json(line), F.lit("-")).alias("found"))


def editor_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("o_orderkey", T.editor_language(F.col("path")).alias("language"))


def error_fix_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short or the full form of the prompt, as each customer asks."""
    c = F.col("c_name")
    made = T.error_fix_prompt(F.expr("CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"), task=c, log=c, tree=c, blocks=c)
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(made.cast("binary")).alias("prompt"))


def parse_multifile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of answers in each of the forms; a file whose path stands in the answer."""
    k = F.col("o_orderkey").cast("string")
    answer = F.expr("o_orderkey % 5").cast("int")
    made = F.when(answer == 0, F.concat(F.lit('{"files": {"a'), k, F.lit('.py": "x = 1"}}'))).when(answer == 1, F.concat(F.lit("**File: b"), k, F.lit(".py**\n```python\nx = 2\n```"))).when(answer == 2, F.concat(F.lit("File: c"), k, F.lit(".py\n```\nx = 3\n```"))).when(answer == 3, F.concat(F.lit("see d"), k, F.lit(".py here\n```py\nx = 4\n```"))).otherwise(F.lit("only prose"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(N.parsed_files(made)).alias("path", "code"))
    return rows.select("o_orderkey", "path", "code")


def retry_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers are asked for again, and how long the prompt is."""
    answer = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('sorry, ', c_name) ELSE concat('File: a.py', chr(10), '```', chr(10), 'x', chr(10), '```') END")
    rows = table(spark, sf_dir, "customer").select("c_custkey", answer.alias("answer")).select("c_custkey", "answer", N.parsed_files(F.col("answer")).alias("files"))
    return rows.select("c_custkey", F.coalesce(F.length(T.retry_prompt(F.col("files"), F.lit("do it"), F.col("answer"))), F.lit(0)).alias("n"))


QUERIES = {f.__name__: f for f in (retry_prompts, fence_language, file_tree, file_blocks, prompt_assembly, prompt_variants, prompt_truncate, normalise_newlines, fenced_blocks, extract_code, analysis_tag, scrub_placeholders, main_file, main_test_file, overlay_merge, size_guard, format_multifile, json_in_text, editor_language, error_fix_prompts, parse_multifile)}

FILES = f"f AS (SELECT o_custkey AS project, {PATH} AS path, {CONTENT} AS content, o_orderkey FROM orders), e AS (SELECT *, CASE WHEN contains(path, '.') THEN CASE lower(regexp_extract(path, '\\.([^.]*)$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FENCE.items())} ELSE lower(regexp_extract(path, '\\.([^.]*)$', 1)) END END AS lang FROM f)"
BLOCK = "'---' || chr(10) || '**File: ' || path || '**' || chr(10) || '```' || coalesce(nullif(lang, ''), 'plaintext') || chr(10) || replace({content}, '```', '``\\`') || chr(10) || '```' || chr(10) || chr(10)"
RANK = "CASE {test} WHEN (contains(path, 'src/') OR contains(path, 'app/') OR len(string_split(path, '/')) <= 2) AND regexp_matches(path, '(^|/)main($|\\.[^/]*$)') THEN 0 WHEN (contains(path, 'src/') OR contains(path, 'app/') OR len(string_split(path, '/')) <= 2) AND regexp_matches(path, '(^|/)app($|\\.[^/]*$)') THEN 1 WHEN (contains(path, 'src/') OR contains(path, 'app/') OR len(string_split(path, '/')) <= 2) AND regexp_matches(path, '(^|/)index($|\\.[^/]*$)') THEN 2 WHEN (contains(path, 'src/') OR contains(path, 'app/') OR len(string_split(path, '/')) <= 2) AND regexp_matches(path, '(^|/)server($|\\.[^/]*$)') THEN 3 ELSE {last} END"
TEST = "contains(lower(path), 'test') OR contains(lower(path), 'spec')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
A = f"a AS (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations)"


def _template_sql(name: str, fill) -> str:
    import re

    return " || ".join(fill(p) if i % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, p in enumerate(re.split(r"\{(\w+)\}", T.TEMPLATES[name])))


SQL = {
    "retry_prompts": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN length(" + _template_sql("strict_json_retry", lambda p: {"error": "'no files found'", "instruction": "'do it'", "reply": "'sorry, ' || c_name"}[p]) + ") ELSE 0 END AS n FROM customer",
    "fence_language": f"WITH {FILES} SELECT o_orderkey, lang AS language FROM e",
    "file_tree": f"WITH {FILES} SELECT project, string_agg('- ' || path || chr(10), '' ORDER BY path) AS tree FROM f GROUP BY project",
    "file_blocks": f"WITH {FILES} SELECT project, string_agg({BLOCK.format(content='CASE WHEN length(content) > 12 THEN left(content, 12) || chr(10) || $$... [truncated]$$ ELSE content END')}, '' ORDER BY o_orderkey) AS blocks FROM e GROUP BY project",
    "prompt_assembly": f"WITH {FILES}, j AS (SELECT project, string_agg('- ' || path || chr(10), '' ORDER BY path) AS tree, string_agg({BLOCK.format(content='content')}, '' ORDER BY path) AS blocks FROM e GROUP BY project) SELECT project, md5({_template_sql('multi_file_task', lambda p: chr(39) + 't' + chr(39) + ' || project' if p == 'task' else p)}) AS prompt FROM j",
    "prompt_variants": "SELECT c_custkey, " + ", ".join(f"md5({_template_sql(n, lambda p: 'c_name')}) AS {n}" for n in T.TEMPLATES if n != "multi_file_task") + " FROM customer",
    "prompt_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || '... [truncated]' ELSE text END) AS cut FROM documents",
    "normalise_newlines": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'a' || chr(10) || c_name || chr(10) || 'b' || chr(10) END AS code FROM customer",
    "fenced_blocks": f"WITH {A}, b AS (SELECT *, unnest(range(len(regexp_extract_all(answer, '{T.FENCED}', 2)))) AS k FROM a) SELECT conv_id, turn, k, coalesce(regexp_extract_all(answer, '{T.FENCED}', 1)[k + 1], '') AS language, md5(regexp_extract_all(answer, '{T.FENCED}', 2)[k + 1]) AS code FROM b",
    "extract_code": f"""WITH {A}, s AS (SELECT conv_id, turn, string_split(answer, '```') AS p FROM a), o AS (SELECT conv_id, turn, unnest(range(2, len(p) + 1, 2)) AS i, p FROM s),
l AS (SELECT conv_id, turn, {STRIP.format('arg_min(p[i], (-length(p[i]), i))')} AS c FROM o GROUP BY conv_id, turn)
SELECT conv_id, turn, md5(CASE WHEN lower({STRIP.format("string_split(c, chr(10))[1]")}) IN ({', '.join(f"'{n}'" for n in T.NAMED)}) THEN {STRIP.format("substr(c, length(string_split(c, chr(10))[1]) + 2)")} ELSE c END) AS code FROM l""",
    "analysis_tag": f"WITH {A} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'n' || conv_id ELSE '' END AS analysis, CAST(CASE WHEN turn % 2 = 0 THEN length('after ```' || chr(10) || 'sh' || chr(10) || 'ls' || chr(10) || '```') ELSE length(answer) END AS INT) AS rest FROM a",
    "scrub_placeholders": "SELECT c_custkey, 'x = \"<redacted>\" ' || c_name AS text FROM customer",
    "main_file": f"WITH {FILES} SELECT project, arg_min(path, ({RANK.format(test='WHEN false THEN -1', last=f'CASE WHEN {TEST} THEN 11 ELSE 10 END')}, path)) AS main FROM f GROUP BY project",
    "main_test_file": f"WITH {FILES} SELECT project, arg_min(path, ({RANK.format(test=f'WHEN {TEST} THEN -1', last='10')}, path)) AS main FROM f GROUP BY project",
    "overlay_merge": "WITH a AS (SELECT c_custkey, c_name AS content FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS content FROM orders GROUP BY 1) SELECT c_custkey, coalesce(b.content, a.content) AS content FROM a FULL JOIN b USING (c_custkey)",
    "size_guard": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) > 30000 AS too_large FROM documents GROUP BY source",
    "format_multifile": f"WITH {FILES} SELECT project, md5(string_agg('**File: ' || path || '**' || chr(10) || '```' || coalesce(lang, '') || chr(10) || replace(content || chr(10), '```', '``\\`') || chr(10) || '```', chr(10) || chr(10) ORDER BY path)) AS text FROM e GROUP BY project",
    "json_in_text": "SELECT event_id, CASE WHEN json_valid(props) THEN props ELSE '-' END AS found FROM events",
    "editor_language": f"WITH {FILES} SELECT o_orderkey, CASE lower(list_extract(string_split(path, '.'), -1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EDITOR.items())} ELSE 'plaintext' END AS language FROM f",
    "error_fix_prompts": f"SELECT c_custkey, md5(CASE WHEN c_custkey % 3 = 0 THEN {_template_sql('error_fix_brief', lambda p: 'c_name')} ELSE {_template_sql('error_fix', lambda p: 'c_name')} END) AS prompt FROM customer",
    "parse_multifile": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END || o_orderkey || '.py' AS path, 'x = ' || (o_orderkey % 5 + 1) || chr(10) AS code FROM orders WHERE o_orderkey % 5 < 4",
}
