"""Queries of redaction, abstraction and the leak gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.patterns import CATEGORIES, PATTERNS, fused, ungrouped
from umbra.operators import abstraction as A
from umbra.operators import protection as S
from umbra.operators import redaction as R
from umbra.sources.readers import spread, table

SALT = "umbra"

#: Texts in which every category occurs, built from customers' keys; one expression for both engines.
BUILT = """concat(
 'k AKIA', lpad(CAST(c_custkey AS STRING), 16, '0'), ' g AIza', lpad(CAST(c_custkey AS STRING), 35, 'x'), ' m ', lpad(CAST(c_custkey AS STRING), 32, 'a'),
 ' s sk_live_', lpad(CAST(c_custkey AS STRING), 24, 'q'), ' t ghp_', lpad(CAST(c_custkey AS STRING), 36, 'Z'), ' api_key = "', lpad(CAST(c_custkey AS STRING), 20, 'p'),
 '" u postgres://u:p', CAST(c_custkey AS STRING), '@host/db p -----BEGIN RSA PRIVATE KEY-----', CAST(c_custkey AS STRING), '-----END RSA PRIVATE KEY----- j aa.bb', CAST(c_custkey AS STRING),
 '.cc e mail', CAST(c_custkey AS STRING), '@example.com f 555-123-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' c 4', lpad(CAST(c_custkey AS STRING), 12, '1'),
 ' i DE44', lpad(CAST(c_custkey AS STRING), 18, '5'), ' a 1234 5678 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '9'), ' n ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F x AB', lpad(CAST(c_custkey AS STRING), 7, '3'),
 ' s 123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' v 1:2:3:4:5:6:7:', CAST(c_custkey % 10000 AS STRING), ' h 00:1B:44:11:3A:', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'),
 ' w 123e4567-e89b-12d3-a456-', lpad(CAST(c_custkey AS STRING), 12, '0'), ' z "aB3dE5gH7jK9mN1pQ', lpad(CAST(c_custkey AS STRING), 6, 'y'), '" low "', lpad(CAST(c_custkey % 10 AS STRING), 24, 'a'), '" end')"""


def customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of customers, dealt out: the table is small, what is made of a row is dear."""
    return spread(table(spark, sf_dir, "customer").select(*columns))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, "c_custkey").select(F.col("c_custkey").alias("id"), F.expr(BUILT).alias("content"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FUSED = _sql_text(fused())
#: The twin of one redaction in SQL: hits with their category, pieces between them, and what each hit becomes.
HITS = f"""
  SELECT id, content, regexp_split_to_array(content, {FUSED}) AS pieces, regexp_extract_all(content, {FUSED}, 0) AS hits,
         CASE WHEN regexp_matches(content, {FUSED}) THEN [{', '.join(f"regexp_extract_all(content, {FUSED}, {k})" for k in range(1, len(CATEGORIES) + 1))}] ELSE [] END AS groups
  FROM src"""
NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


def _entropy_sql(s: str) -> str:
    return f"(-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: (len(list_filter(string_split({s}, ''), lambda x: x = c)) / length({s})) * log2(len(list_filter(string_split({s}, ''), lambda x: x = c)) / length({s})))))"


ITEMS = f"""
hit AS MATERIALIZED ({HITS}),
found AS (
  SELECT id, i, {NAMES_SQL}[list_position(list_transform(groups, lambda g: coalesce(g[i], '') <> ''), true)] AS category, hits[i] AS raw, pieces[i + 1] AS tail
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hit)),
item AS (
  SELECT *, CASE WHEN category = 'HIGH_ENTROPY_STRING' THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS value FROM found),
secret AS (
  SELECT *, category <> 'HIGH_ENTROPY_STRING' OR (length(value) >= 20 AND {_entropy_sql('value')} > 4) AS hidden,
         '<<REDACTED_' || category || '_' || substr(sha256('{SALT}' || value), 1, 16) || '>>' AS placeholder FROM item),
safe AS (
  SELECT h.id, h.content, h.pieces[1] || coalesce(string_agg(CASE WHEN hidden THEN placeholder ELSE raw END || tail, '' ORDER BY i), '') AS redacted
  FROM hit h LEFT JOIN secret s ON h.id = s.id GROUP BY h.id, h.content, h.pieces)"""

SRC = {
    "documents": "SELECT doc_id AS id, coalesce(text, '') AS content FROM documents",
    "pages": "SELECT page_id AS id, coalesce(html, '') AS content FROM pages",
    "built": f"SELECT c_custkey AS id, {BUILT} AS content FROM customer",
}


def source(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    if of == "built":
        return built(spark, sf_dir)
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[of]
    return spread(table(spark, sf_dir, of).select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("content")))


def sql(of: str, body: str) -> str:
    return f"WITH src AS ({SRC[of]}), {ITEMS} {body}"


def redacted(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    return R.redact(source(spark, sf_dir, of), salt=SALT)


def redact_text(of: str):
    return lambda spark, sf_dir: redacted(spark, sf_dir, of).select("id", "redacted")


def inventory(of: str):
    return lambda spark, sf_dir: R.events(redacted(spark, sf_dir, of), "id")


def category_totals(of: str):
    return lambda spark, sf_dir: R.events(redacted(spark, sf_dir, of)).select("category", "n")


def secret_map_long(of: str):
    return lambda spark, sf_dir: R.secret_map(redacted(spark, sf_dir, of), "id")


def placeholder_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that several pages share: in how many, and of which category."""
    return R.secret_map(redacted(spark, sf_dir, "pages"), "id").groupBy("category", "placeholder").agg(F.count("*").alias("n")).where("n > 1")


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.redact(built(spark, sf_dir), salt=SALT, mode="fixed")
    return rows.select("id", (R.restored(F.col("redacted"), F.transform("secrets", lambda s: F.struct(s["placeholder"].alias("placeholder"), s["value"].alias("value")))) == F.col("content")).alias("same"))


def restore_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One placeholder begins like another; the longer one is replaced first."""
    pairs = F.array(F.struct(F.lit("<<A_1").alias("placeholder"), F.lit("short").alias("value")), F.struct(F.lit("<<A_12>>").alias("placeholder"), F.col("c_name").alias("value")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.restored(F.concat(F.lit("x <<A_12>> y <<A_1 z"), F.col("c_custkey").cast("string")), pairs).alias("restored"))


def forget_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = R.secret_map(redacted(spark, sf_dir, "built"), "id")
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return R.forget(mapping, gone, "id").select("id", "category", "placeholder")


def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of documents with their entropy, and whether a secret scan would take them."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9/+=_]{20,}"), F.lit(0)))).alias("word"))
    return words.select("doc_id", "word", F.round(R.entropy(F.col("word")), 6).alias("entropy"), R.high_entropy(F.col("word"), 3.5).alias("high"))


def span_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last word of names hidden as entities, from the right."""
    name = F.col("c_name")
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("NAME").alias("label"), F.substring(name, 1, 4).alias("value")), F.struct((F.length(name) - 3).alias("start"), F.length(name).alias("end"), F.lit("DATE").alias("label"), F.substring(name, -3, 3).alias("value")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.spliced(name, spans, SALT).alias("safe"))


CODE = """concat('function f', CAST(c_custkey AS STRING), '(a, b', CAST(c_custkey % 5 AS STRING), ') { // note ', c_name, chr(10), '  const total = a - 5 + 1.5e3; /* block ', chr(10), ' end */ let s = "it''s \\\\"', c_name, '\\\\""; return total + ', CAST(c_custkey AS STRING), '; }', chr(10))"""
CODE_SPARK = CODE.replace("''", "\\'")
CODE_SQL = CODE.replace("\\\\", "\\")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), F.expr(CODE_SPARK).alias("code"))


def _label_sql(text: str, pattern: str, category: str) -> str:
    """text with the matches of a one-group pattern labelled, in SQL."""
    p = _sql_text(pattern)
    return f"array_to_string(list_transform(regexp_split_to_array({text}, {p}), lambda x, i: x || CASE WHEN i <= len(regexp_extract_all({text}, {p}, 0)) THEN '<<{category}_' || substr(sha256('{SALT}' || regexp_extract_all({text}, {p}, 0)[i]), 1, 12) || '>>' ELSE '' END), '')"


PASSES = f"""src AS (SELECT c_custkey AS id, {CODE_SQL} AS code FROM customer),
p1 AS (SELECT id, code, {_label_sql('code', A.STRING_SQL, 'STRING')} AS s FROM src),
p2 AS (SELECT id, code, s, {_label_sql('s', A.NUMBER, 'NUMBER')} AS n FROM p1),
p3 AS (SELECT id, code, s, n, {_label_sql('n', A.COMMENT, 'COMMENT')} AS c FROM p2)"""

SKIP_SQL = "[" + ", ".join(_sql_text(w) for w in A.skip_words("javascript")) + "]"
IDENT = _sql_text(A.IDENTIFIER)
ABSTRACTED = f"""{PASSES},
p4 AS (
  SELECT id, code, c, array_to_string(list_transform(regexp_split_to_array(c, {IDENT}), lambda x, i: x || CASE
     WHEN i > len(regexp_extract_all(c, {IDENT}, 0)) THEN ''
     WHEN starts_with(regexp_extract_all(c, {IDENT}, 0)[i], '<<') OR list_contains({SKIP_SQL}, regexp_extract_all(c, {IDENT}, 0)[i]) THEN regexp_extract_all(c, {IDENT}, 0)[i]
     ELSE '<<IDENT_' || substr(sha256('{SALT}' || regexp_extract_all(c, {IDENT}, 0)[i]), 1, 12) || '>>' END), '') AS safe
  FROM p3)"""


def abstract_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("id", A.strings(F.col("code"), SALT).alias("safe"))


def abstract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("id", A.numbers(A.strings(F.col("code"), SALT), SALT).alias("safe"))


def abstract_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("id", A.comments(A.numbers(A.strings(F.col("code"), SALT), SALT), SALT).alias("safe"))


def abstract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code(spark, sf_dir).select("id", A.abstracted(F.col("code"), "javascript", salt=SALT).alias("safe"))


def abstract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of whole pages, an unknown language."""
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.sha2(A.identifiers(F.coalesce("html", F.lit("")), A.skip_words("unknown"), SALT), 256).alias("safe"))


def abstract_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored from its mapping, abstracted code is what it was (comments and strings open before what they hold)."""
    rows = code(spark, sf_dir).select("id", "code", A.abstracted(F.col("code"), "javascript", salt=SALT).alias("safe"), A.mapping(F.col("code"), "javascript", salt=SALT).alias("m"))
    of = lambda *kinds: F.transform(F.filter("m", lambda x: x["kind"].isin(*kinds)), lambda x: F.struct(x["placeholder"].alias("placeholder"), x["original"].alias("value")))
    opened = R.restored(R.restored(R.restored(F.col("safe"), of("IDENT", "COMMENT")), of("NUMBER")), of("STRING"))
    return rows.select("id", (opened == F.col("code")).alias("same"))


def detect_language_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets(spark, sf_dir)
    return rows.select("id", "path", A.language4(F.col("code"), F.col("path")).alias("language"))


def detect_language_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets(spark, sf_dir)
    return rows.select("id", "path", A.language8(F.col("code"), F.col("path")).alias("language"))


SNIPPET = """CASE o_orderkey % 12 WHEN 0 THEN 'def f(x): return x' WHEN 1 THEN 'function f() { console.log(1) }' WHEN 2 THEN 'interface A { } function g() {}' WHEN 3 THEN 'public class A { }'
 WHEN 4 THEN '#include <a.h>' WHEN 5 THEN '<?php echo 1;' WHEN 6 THEN 'fn main() { let x = 1; }' WHEN 7 THEN 'const f = (a) => a' WHEN 8 THEN 'import os' WHEN 9 THEN 'System.out.println(1)' WHEN 10 THEN 'func main() {}' ELSE 'plain words' END"""
PATH = "concat('src/f', CAST(o_custkey AS STRING), CASE o_orderkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.java' WHEN 3 THEN '.rs' ELSE '' END)"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(PATH).alias("path"), F.expr(SNIPPET).alias("code"))


SNIPPETS_SQL = f"SELECT o_orderkey AS id, {PATH} AS path, {SNIPPET} AS code FROM orders"
LANGUAGE4_SQL = rf"""WITH s AS ({SNIPPETS_SQL})
SELECT id, path, CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN regexp_matches(lower(path), '\.jsx?$') THEN 'javascript' WHEN regexp_matches(lower(path), '\.tsx?$') THEN 'typescript' WHEN lower(path) LIKE '%.java' THEN 'java'
  WHEN regexp_matches(code, '\b(def|class)\s+\w+\b|\bimport\s+\w+') THEN 'python'
  WHEN contains(code, 'function ') OR contains(code, 'console.log') THEN CASE WHEN regexp_matches(code, '\binterface\b|\btype\b') THEN 'typescript' ELSE 'javascript' END
  WHEN contains(code, 'public class') THEN 'java' ELSE 'unknown' END AS language FROM s"""
LANGUAGE8_SQL = rf"""WITH s AS ({SNIPPETS_SQL})
SELECT id, path, CASE {' '.join(f"WHEN lower(path) LIKE '%{e}' THEN '{n}'" for e, n in A.EXTENSIONS.items())}
  WHEN starts_with(code, '<?php') OR regexp_matches(code, '\bnamespace\b.*;') THEN 'php'
  WHEN regexp_matches(code, '\b(def|class)\s+\w+\b|\bimport\s+\w+') AND NOT contains(substr(code, 1, 200), '{{') THEN 'python'
  WHEN contains(code, 'function ') OR contains(code, 'console.log') OR contains(code, '=> ') OR contains(code, 'module.exports') OR regexp_matches(code, '\bimport\s+.*from\s+[''"]')
    THEN CASE WHEN regexp_matches(code, '\binterface\b|\btype\b|\b: [A-Za-z0-9_\[\]\|<>{{}}, ]+\b') THEN 'typescript' ELSE 'javascript' END
  WHEN contains(code, 'public class') OR contains(code, 'System.out.println') OR regexp_matches(code, '\bpackage\b\s+[a-zA-Z0-9_.]+') THEN 'java'
  WHEN contains(code, '#include') OR contains(code, 'int main(') THEN 'c_cpp'
  WHEN contains(code, 'package main') AND contains(code, 'func main()') THEN 'go' WHEN contains(code, 'fn main()') AND contains(code, 'let ') THEN 'rust' ELSE 'unknown' END AS language FROM s"""


def placeholder_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut to few digits collide; the suffix keeps them apart."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("original"), F.concat(F.lit("<<VAR_"), F.substring(F.sha2("c_name", 256), 1, 2), F.lit(">>")).alias("label"))
    return A.suffixed(names, "label", "original").select("original", "label")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe texts with faults built in: every third mapping lacks a name, every fifth text shows one."""
    skip = A.skip_words("javascript")
    rows = code(spark, sf_dir).select("id", "code", A.abstracted(F.col("code"), "javascript", salt=SALT).alias("safe"), A.harvested(F.col("code"), skip).alias("names"))
    return rows.withColumn("names", F.when(F.col("id") % 3 == 0, F.array_remove("names", "total")).otherwise(F.col("names"))).withColumn("safe", F.when(F.col("id") % 5 == 0, F.concat("safe", F.lit(" total "))).otherwise(F.col("safe")))


def leak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.gated(_gate(spark, sf_dir), "code", "safe", "names", skip=A.skip_words("javascript"))
    return rows.select("id", "error", F.col("safe").isNull().alias("blocked"))


def _names(rows: DataFrame, names: Column) -> DataFrame:
    """id and each name; outer, as an inner explode makes the names again in a filter below the exchange."""
    return rows.select("id", F.explode_outer(names).alias("name")).where("name IS NOT NULL")


def leak_gate_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the code that no mapping has: an anti join of names."""
    rows = _gate(spark, sf_dir)
    seen = _names(rows, A.harvested(F.col("code"), A.skip_words("javascript")))
    return seen.join(_names(rows, F.col("names")), ["id", "name"], "left_anti")


def leak_gate_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped names that still stand in the safe text: a semi join of names."""
    rows = _gate(spark, sf_dir)
    return _names(rows, F.col("names")).join(_names(rows, A.visible(F.col("safe"))), ["id", "name"], "left_semi")


def secret_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which redacted texts still hold a secret of eight characters or more; every seventh has one put back."""
    rows = redacted(spark, sf_dir, "built").select("id", "secrets", F.when(F.col("id") % 7 == 0, F.concat("redacted", F.col("secrets")[0]["value"])).otherwise(F.col("redacted")).alias("safe"))
    return rows.select("id", F.exists("secrets", lambda s: (F.length(s["value"]) >= 8) & F.contains(F.col("safe"), s["value"])).alias("survived"))


def mask_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redacted(spark, sf_dir, "built")
    return rows.select("id", A.masked(F.col("redacted")).alias("masked"), (A.unmasked(A.masked(F.col("redacted")), F.transform("secrets", lambda s: s["placeholder"])) == F.col("redacted")).alias("same"))


def python_ast_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("def area"), F.col("c_custkey").cast("string"), F.lit('(width, height=2):\n    "doc"\n    label = "'), F.col("c_name"), F.lit('"\n    return width * height'), F.when(F.col("c_custkey") % 10 == 0, " (").otherwise(""))
    out = A.python_abstractor(SALT, level="paranoid")(made)
    return customers(spark, sf_dir, "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), out.alias("r")).select("id", "r.abstracted", F.coalesce(F.size("r.mapping"), F.lit(-1)).alias("names"), "r.error")


def privacy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: distinct secrets, distinct identifiers of what is left, and the tokens that redaction saves, at four characters each."""
    rows = redacted(spark, sf_dir, "pages")
    return rows.select("id", F.size(F.array_distinct(F.transform("secrets", lambda s: s["placeholder"]))).alias("secrets"), F.size(A.visible(F.col("redacted"))).alias("identifiers"), F.expr("greatest(0, length(content) - length(redacted)) div 4").alias("tokens_saved"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JavaScript with secrets in the open, in strings and in comments."""
    secret = F.concat(F.lit("ghp_"), F.lpad(F.col("id").cast("string"), 36, "Z"))
    body = F.concat("code", F.lit("let key = `"), secret, F.lit("`; // mail m"), "id", F.lit("@example.com\nsend(10.1.2.3)\n"))
    return code(spark, sf_dir).select(F.concat(F.lit("src/f"), "id", F.lit(".js")).alias("path"), body.alias("content"))


def protect_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file is released without its secrets and names, and comes back as it was."""
    corpus = _corpus(spark, sf_dir)
    safe = S.protect(corpus, salt=SALT)
    again = S.reopened(F.col("safe"), F.col("mapping"), F.col("secrets"))
    gone = ~F.contains("safe", F.lit("ghp_")) & ~F.contains("safe", F.lit("total")) & F.contains("safe", F.lit("function"))
    return corpus.join(safe, "path").select("path", "error", gone.alias("hidden"), (again == F.col("content")).alias("same")).fillna("", "error")


def protect_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is released of each file, and how many of its names, numbers, comments and strings were mapped."""
    files = code(spark, sf_dir).select(F.concat(F.lit("src/f"), "id", F.lit(".js")).alias("path"), F.col("code").alias("content"))
    safe = S.protect(files, salt=SALT)
    return safe.select("path", "safe", F.size("mapping").alias("mapped"), F.size("secrets").alias("secrets"), F.col("error").isNull().alias("released"))


def protect_short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With labels of two digits, which many originals share, every file still comes back as it was."""
    corpus = _corpus(spark, sf_dir)
    safe = S.protect(corpus, salt=SALT, digits=2, unique=True)
    again = S.reopened(F.col("safe"), F.col("mapping"), F.col("secrets"))
    labels = F.transform("mapping", lambda m: m["placeholder"])
    return corpus.join(safe, "path").select("path", (again == F.col("content")).alias("same"), (F.size(F.array_distinct(labels)) == F.size(labels)).alias("apart")).fillna(False)


def _functions(code: Column, path: Column) -> Column:
    """A pass of our own for Go: the name of a file's first function and its strings; a file without function isn't taken."""
    name = F.regexp_extract(code, r"func (\w+)", 1)
    shown = A.label("FUNC", name, SALT)
    of = F.array(F.struct(F.lit("FUNC").alias("kind"), name.alias("original"), shown.alias("placeholder")))
    strings = F.filter(A.mapping(code, "unknown", [], SALT), lambda m: m["kind"] == "STRING")
    return F.struct(A.strings(F.replace(code, name, shown), SALT).alias("safe"), F.concat(of, strings).alias("mapping"), F.when(name == "", "no function").alias("error"))


def protect_own_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go by a pass of its own; files that it doesn't take, every tenth, are abstracted as code of an unknown language."""
    body = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("var pay"), "c_custkey", F.lit(' = "'), "c_mktsegment", F.lit('"'))).otherwise(F.concat(F.lit("func pay"), "c_custkey", F.lit('() string { return "'), "c_mktsegment", F.lit('" }')))
    files = customers(spark, sf_dir, "c_custkey", "c_mktsegment").select(F.concat(F.lit("p"), "c_custkey", F.lit(".go")).alias("path"), F.concat(F.lit("package main\n\n"), body).alias("content"))
    safe = S.protect(files, salt=SALT, passes={"go": _functions})
    again = S.reopened(F.col("safe"), F.col("mapping"), F.col("secrets"))
    text = F.when(F.contains("content", F.lit("func")), F.col("safe")).when(F.contains("safe", F.lit("pay")), "shown").otherwise("hidden")
    return files.join(safe, "path").select("path", "language", text.alias("safe"), (again == F.col("content")).alias("same"))


def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffixes of a corpus' strings, numbers and names with labels of three digits."""
    stays = A.staying(A.skip_words("javascript"))
    entries = code(spark, sf_dir).select(F.explode(A.folded(F.col("code"), stays, SALT)["entries"]).alias("e")).select("e.*")
    return A.shared_labels(entries, SALT, 3, ("STRING", "NUMBER", "IDENT"))


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("import os\n\ndef wage"), "c_custkey", F.lit("(hours):\n    token = 'ghp_"), F.lpad(F.col("c_custkey").cast("string"), 36, "q"), F.lit("'\n    return hours * 3"), F.when(F.col("c_custkey") % 10 == 0, " (").otherwise(""))
    return customers(spark, sf_dir, "c_custkey").select(F.concat(F.lit("f"), "c_custkey", F.lit(".py")).alias("path"), made.alias("content"))


def secure_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of what a model is shown of a file: what was hidden, or why it is blocked."""
    return S.shown_to_model(S.protect(_python(spark, sf_dir), salt=SALT)).select("path", F.substring_index("body", "\n", 1).alias("header"))


def protect_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files; every tenth can't be parsed and is blocked."""
    safe = S.protect(_python(spark, sf_dir), salt=SALT)
    return safe.select("path", F.col("error").isNotNull().alias("blocked"), F.coalesce(F.contains("safe", F.lit("wage")) | F.contains("safe", F.lit("ghp_")), F.lit(False)).alias("leaks"), F.coalesce(F.contains("safe", F.lit("def ")), F.lit(False)).alias("kept_structure"))


QUERIES = {
    "protect_roundtrip": protect_roundtrip,
    "protect_released": protect_released,
    "protect_short_labels": protect_short_labels,
    "label_dictionary": label_dictionary,
    "protect_own_pass": protect_own_pass,
    "protect_python": protect_python,
    "secure_read": secure_read,
    "redact_match_inventory": inventory("documents"),
    "redact_match_inventory_pages": inventory("pages"),
    "redact_category_totals": category_totals("built"),
    "redact_text_documents": redact_text("documents"),
    "redact_text_pages": redact_text("pages"),
    "redact_text_built": redact_text("built"),
    "secret_map_long": secret_map_long("built"),
    "placeholder_reuse": placeholder_reuse,
    "restore_roundtrip": restore_roundtrip,
    "restore_longest_first": restore_longest_first,
    "forget_subject": forget_subject,
    "entropy_candidates": entropy_candidates,
    "span_replacement": span_replacement,
    "abstract_strings": abstract_strings,
    "abstract_numbers": abstract_numbers,
    "abstract_comments": abstract_comments,
    "abstract_identifiers": abstract_identifiers,
    "abstract_pages": abstract_pages,
    "abstract_roundtrip": abstract_roundtrip,
    "detect_language_4": detect_language_4,
    "detect_language_8": detect_language_8,
    "stable_placeholder_collisions": placeholder_collisions,
    "leak_gate": leak_gate,
    "leak_gate_unmapped": leak_gate_unmapped,
    "leak_gate_visible": leak_gate_visible,
    "secret_survival": secret_survival,
    "mask_placeholders": mask_placeholders,
    "python_ast_abstract": python_ast_abstract,
    "privacy_report": privacy_report,
}

def _tag(kind: str, of: str) -> str:
    return f"('<<{kind}_' || substr(sha256('{SALT}' || {of}), 1, 12) || '>>')"


GATE = f"""{ABSTRACTED},
h AS (SELECT id, code, safe, list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(code, {_sql_text(A.STRING_SQL)}, ' ', 'g'), {_sql_text(A.COMMENT)}, ' ', 'g'), {IDENT}, 2)), lambda x: x <> '' AND NOT list_contains({SKIP_SQL}, x)) AS seen FROM p4),
g AS (SELECT id, seen, CASE WHEN id % 3 = 0 THEN list_filter(seen, lambda x: x <> 'total') ELSE seen END AS names, CASE WHEN id % 5 = 0 THEN safe || ' total ' ELSE safe END AS safe FROM h),
v AS (SELECT *, list_filter(list_distinct(regexp_extract_all(safe, {IDENT}, 2)), lambda x: x <> '') AS visible FROM g)"""

SQL = {
    "protect_roundtrip": "SELECT 'src/f' || c_custkey || '.js' AS path, '' AS error, true AS hidden, true AS same FROM customer",
    "protect_released": f"""WITH {ABSTRACTED} SELECT 'src/f' || p3.id || '.js' AS path, safe, CAST(len(list_distinct(regexp_extract_all(p3.code, {_sql_text(A.STRING_SQL)}, 1))) + len(list_distinct(regexp_extract_all(p3.s, {_sql_text(A.NUMBER)}, 1))) + len(list_distinct(regexp_extract_all(p3.n, {_sql_text(A.COMMENT)}, 1)))
  + len(list_filter(list_distinct(regexp_extract_all(p3.c, {IDENT}, 0)), lambda x: NOT starts_with(x, '<<') AND NOT list_contains({SKIP_SQL}, x))) AS INTEGER) AS mapped, 0 AS secrets, true AS released FROM p3 JOIN p4 USING (id)""",
    "protect_short_labels": "SELECT 'src/f' || c_custkey || '.js' AS path, true AS same, true AS apart FROM customer",
    "label_dictionary": f"""WITH {ABSTRACTED}, x AS (SELECT DISTINCT kind, original FROM (SELECT 'STRING' AS kind, unnest(regexp_extract_all(code, {_sql_text(A.STRING_SQL)}, 1)) AS original FROM p3 UNION ALL SELECT 'NUMBER', unnest(regexp_extract_all(s, {_sql_text(A.NUMBER)}, 1)) FROM p3
  UNION ALL SELECT 'IDENT', unnest(list_filter(list_distinct(regexp_extract_all(c, {IDENT}, 0)), lambda x: NOT starts_with(x, '<<') AND NOT list_contains({SKIP_SQL}, x))) FROM p3)),
n AS (SELECT kind, original, row_number() OVER (PARTITION BY kind, substr(sha256('{SALT}' || original), 1, 3) ORDER BY original) - 1 AS n FROM x) SELECT kind, original, '_' || n AS suffix FROM n WHERE n > 0""",
    "protect_own_pass": f"""SELECT 'p' || c_custkey || '.go' AS path, 'go' AS language, CASE WHEN c_custkey % 10 = 0 THEN 'hidden' ELSE 'package main' || chr(10) || chr(10) || 'func <<FUNC_' || substr(sha256('{SALT}' || 'pay' || c_custkey), 1, 12) || '>>() string {{ return <<STRING_' || substr(sha256('{SALT}' || '"' || c_mktsegment || '"'), 1, 12) || '>> }}' END AS safe, true AS same FROM customer""",
    "protect_python": "SELECT 'f' || c_custkey || '.py' AS path, c_custkey % 10 = 0 AS blocked, false AS leaks, c_custkey % 10 <> 0 AS kept_structure FROM customer",
    "redact_match_inventory": sql("documents", "SELECT id, category, count(*) AS n FROM secret WHERE hidden GROUP BY id, category"),
    "redact_match_inventory_pages": sql("pages", "SELECT id, category, count(*) AS n FROM secret WHERE hidden GROUP BY id, category"),
    "redact_category_totals": sql("built", "SELECT category, count(*) AS n FROM secret WHERE hidden GROUP BY category"),
    "redact_text_documents": sql("documents", "SELECT id, redacted FROM safe"),
    "redact_text_pages": sql("pages", "SELECT id, redacted FROM safe"),
    "redact_text_built": sql("built", "SELECT id, redacted FROM safe"),
    "secret_map_long": sql("built", "SELECT DISTINCT id, category, placeholder, value AS original FROM secret WHERE hidden"),
    "placeholder_reuse": sql("pages", "SELECT category, placeholder, count(DISTINCT id) AS n FROM secret WHERE hidden GROUP BY category, placeholder HAVING count(DISTINCT id) > 1"),
    "restore_roundtrip": "SELECT c_custkey AS id, true AS same FROM customer",
    "restore_longest_first": "SELECT c_custkey, 'x ' || c_name || ' y short z' || CAST(c_custkey AS VARCHAR) AS restored FROM customer",
    "forget_subject": sql("built", "SELECT DISTINCT id, category, placeholder FROM secret WHERE hidden AND id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "entropy_candidates": f"SELECT doc_id, word, round({_entropy_sql('word')}, 6) AS entropy, {_entropy_sql('word')} > 3.5 AS high FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9/+=_]{{20,}}'))) AS word FROM documents)",
    "span_replacement": f"SELECT c_custkey, '<<REDACTED_NAME_' || substr(sha256('{SALT}' || substr(c_name, 1, 4)), 1, 16) || '>>' || substr(c_name, 5, length(c_name) - 7) || '<<REDACTED_DATE_' || substr(sha256('{SALT}' || right(c_name, 3)), 1, 16) || '>>' AS safe FROM customer",
    "abstract_strings": f"WITH {PASSES} SELECT id, s AS safe FROM p1",
    "abstract_numbers": f"WITH {PASSES} SELECT id, n AS safe FROM p2",
    "abstract_comments": f"WITH {PASSES} SELECT id, c AS safe FROM p3",
    "abstract_identifiers": f"WITH {ABSTRACTED} SELECT id, safe FROM p4",
    "abstract_pages": f"""WITH h AS (SELECT page_id, regexp_split_to_array(coalesce(html, ''), {IDENT}) AS pieces, regexp_extract_all(coalesce(html, ''), {IDENT}, 0) AS hits FROM pages),
u AS (SELECT page_id, unnest(pieces) AS piece, unnest(list_append(hits, '')) AS hit, unnest(range(len(pieces))) AS i FROM h)
SELECT page_id, sha256(string_agg(piece || CASE WHEN hit = '' OR starts_with(hit, '<<') OR hit IN ({', '.join(_sql_text(w) for w in A.skip_words('unknown'))}) THEN hit ELSE '<<IDENT_' || substr(sha256('{SALT}' || hit), 1, 12) || '>>' END, '' ORDER BY i)) AS safe FROM u GROUP BY page_id""",
    "abstract_roundtrip": "SELECT c_custkey AS id, true AS same FROM customer",
    "detect_language_4": LANGUAGE4_SQL,
    "detect_language_8": LANGUAGE8_SQL,
    "stable_placeholder_collisions": "SELECT original, label || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS label FROM (SELECT c_name AS original, '<<VAR_' || substr(sha256(c_name), 1, 2) || '>>' AS label, row_number() OVER (PARTITION BY substr(sha256(c_name), 1, 2) ORDER BY c_name) - 1 AS k FROM customer)",
    "leak_gate": f"WITH {GATE} SELECT id, CASE WHEN len(list_filter(seen, lambda x: NOT list_contains(names, x))) > 0 THEN len(list_filter(seen, lambda x: NOT list_contains(names, x))) || ' identifier(s) unabstracted' WHEN len(list_intersect(names, visible)) > 0 THEN 'an identifier is visible' END AS error, (len(list_filter(seen, lambda x: NOT list_contains(names, x))) > 0 OR len(list_intersect(names, visible)) > 0) AS blocked FROM v",
    "leak_gate_unmapped": f"WITH {GATE} SELECT id, unnest(list_filter(seen, lambda x: NOT list_contains(names, x))) AS name FROM v",
    "leak_gate_visible": f"WITH {GATE} SELECT id, unnest(list_intersect(names, visible)) AS name FROM v",
    "secret_survival": sql("built", "SELECT s.id, bool_or(hidden AND length(value) >= 8 AND contains(CASE WHEN s.id % 7 = 0 THEN redacted || f.v ELSE redacted END, value)) AS survived FROM secret s JOIN safe USING (id) JOIN (SELECT id, arg_min(value, i) AS v FROM secret WHERE hidden GROUP BY id) f ON f.id = s.id GROUP BY s.id"),
    "mask_placeholders": sql("built", "SELECT id, regexp_replace(redacted, '<<([^<>]+)>>', '__MASK_\\1__', 'g') AS masked, true AS same FROM safe"),
    "python_ast_abstract": f"""WITH c AS (SELECT c_custkey AS id, c_name, c_custkey % 10 = 0 AS broken FROM customer)
SELECT id, CASE WHEN NOT broken THEN 'class ' || {_tag('NOISE', "'_noisenoise_class'")} || ': pass' || chr(10) || chr(10) || 'def ' || {_tag('NOISE', "'_noisenoise_func'")} || '(): return ' || {_tag('NOISE', "'_noiseNOISE'")} || chr(10) || chr(10)
 || 'def ' || {_tag('FUNC', "'area' || id")} || '(' || {_tag('PARAM', "'width'")} || ', ' || {_tag('PARAM', "'height'")} || '=' || chr(39) || {_tag('NUM', "'2'")} || chr(39) || '):' || chr(10) || '    ' || repeat(chr(34), 3) || {_tag('DOC', "'DOCSTRING'")} || repeat(chr(34), 3) || chr(10)
 || '    ' || {_tag('VAR', "'label'")} || ' = ' || chr(39) || {_tag('STR', "c_name")} || chr(39) || chr(10) || '    return ' || {_tag('PARAM', "'width'")} || ' * ' || {_tag('PARAM', "'height'")} END AS abstracted,
 CASE WHEN broken THEN -1 ELSE 6 END AS names, CASE WHEN broken THEN 'Python parse failed: SyntaxError' END AS error FROM c""",
    "secure_read": "SELECT 'f' || c_custkey || '.py' AS path, CASE WHEN c_custkey % 10 = 0 THEN 'blocked: Python parse failed: SyntaxError' ELSE 'secrets hidden: 0, names hidden: 8' END AS header FROM customer",
    "privacy_report": sql("pages", f"SELECT s.id, len(list_filter(list_distinct(regexp_extract_all(redacted, {IDENT}, 2)), lambda x: x <> '')) AS identifiers, (SELECT count(DISTINCT placeholder) FROM secret x WHERE x.id = s.id AND hidden) AS secrets, CAST(greatest(0, length(content) - length(redacted)) // 4 AS BIGINT) AS tokens_saved FROM safe s"),
}
assert re.compile(ungrouped("|".join(PATTERNS.values()))).groups == 0
