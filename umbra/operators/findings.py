"""Findings of code checkers: one row for each, parsed from reports, deduplicated, capped and rolled up."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.patterns import ASCII_EDGE, let, relabelled
from umbra.operators.text import stripped

CAP, RAW_LIMIT = 1000, 20_000

#: The line formats, as regular expressions over one trimmed line. Group numbers follow in READ.
LINES = {
    "flake8": r"^([^:]+):(\d+):(\d+):\s*(\w+)\s+(.+)$",
    "mypy": r"(?i)^([^:]+):(\d+):\s*(\d+):\s*error:\s*(.+)$",
    "tsc": r"(?i)^([^()]+)\((\d+),(\d+)\):\s*(error|warning)\s*(TS\d+):\s*(.+)$",
    "javac": r"(?i)^([^:]+):(\d+):\s*(error|warning):\s*(.+)$",
    "clang-tidy": r"(?i)^([^:]+):(\d+):(\d+):\s*(warning|error|note):\s*(.+?)(?:\s+\[([^\]]+)\])?$",
    "go vet": r"^([^:]+):(\d+):\s*(.+)$",
    "cargo": r"(?i)^([^:]+):(\d+):(\d+):\s*(error|warning):\s*(.+)$",
    "generic": r"^([^:]+):(\d+):(?:(\d+):)?\s*(.+)$",
}
#: tool: the groups of message, column (0: none), severity or code (0: none).
READ = {"flake8": (5, 3, 4), "mypy": (4, 3, 0), "tsc": (6, 3, 4), "javac": (4, 0, 3), "clang-tidy": (5, 3, 4), "go vet": (3, 0, 0), "cargo": (5, 3, 4), "generic": (4, 3, 0)}
SUGGESTIONS = {"mypy": "Add/adjust type annotations or configure mypy.", "javac": "Fix compilation errors."}


def safe_int(x: Column) -> Column:
    return x.try_cast("int")


def _finding(tool: str, line: Column, generic: str) -> dict[str, Column]:
    of = lambda i: F.regexp_extract(line, LINES[tool], i)
    message, column, level = READ[tool]
    low = F.lower(of(level)) if level else None
    error = lambda c: F.when(c, "error").otherwise("warning")
    severity = {
        "flake8": lambda: F.when(of(4).startswith("W"), "warning").otherwise("error"),
        "mypy": lambda: F.lit("error"),
        "tsc": lambda: error(low == "error"),
        "javac": lambda: error(F.contains(F.lower(line), F.lit("error"))),
        "clang-tidy": lambda: F.when(low == "error", "error").when(low == "warning", "warning").otherwise("info"),
        "go vet": lambda: F.lit("warning"),
        "cargo": lambda: error(low == "error"),
        "generic": lambda: F.lit("warning"),
    }[tool]()
    name = {
        "flake8": lambda: F.concat(F.lit("flake8:"), of(4)),
        "mypy": lambda: F.lit("mypy:type"),
        "tsc": lambda: F.concat(F.lit("tsc:"), of(5)),
        "javac": lambda: F.lit("javac"),
        "clang-tidy": lambda: F.concat(F.lit("clang-tidy:"), F.when(of(6) == "", "unknown").otherwise(of(6))),
        "go vet": lambda: F.lit("govet"),
        "cargo": lambda: F.concat(F.lit("cargo:"), severity),
        "generic": lambda: F.lit(f"{generic}:generic"),
    }[tool]()
    return {
        "id": name,
        "tool": F.lit(generic if tool == "generic" else tool),
        "severity": severity,
        "message": F.trim(of(message)) if tool == "clang-tidy" else of(message),
        "file": F.trim(of(1)) if tool == "tsc" else of(1),
        "line": safe_int(of(2)),
        "column": safe_int(of(column)) if column else F.lit(None).cast("int"),
        "suggestion": F.lit(SUGGESTIONS.get(tool)).cast("string"),
    }


def parsed(reports: DataFrame, tool: str, text: str, *keys: str, generic: str = "generic") -> DataFrame:
    """keys, ordinal and a finding's columns of each line of a text report that has the tool's format."""
    lines = reports.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")).alias("ordinal", "raw")).withColumn("raw", F.trim("raw"))
    found = lines.where(F.col("raw").rlike(LINES[tool]))
    return found.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), *[c.alias(n) for n, c in _finding(tool, F.col("raw"), generic).items()])


BANDIT = "struct<results:array<struct<filename:string,line_number:string,issue_severity:string,test_id:string,issue_text:string,issue_confidence:string,more_info:string>>>"
ESLINT = "array<struct<filePath:string,file:string,messages:array<struct<ruleId:string,severity:int,message:string,line:string,column:string>>>>"


def parsed_bandit(reports: DataFrame, text: str, *keys: str) -> DataFrame:
    """The same of a JSON report with results; bad JSON has none."""
    rows = reports.select(*keys, F.posexplode(F.from_json(F.col(text), BANDIT)["results"]).alias("ordinal", "r"))
    low = F.lower(F.coalesce("r.issue_severity", F.lit("")))
    return rows.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), F.concat(F.lit("bandit:"), F.coalesce(F.nullif("r.test_id", F.lit("")), F.lit("unknown"))).alias("id"), F.lit("bandit").alias("tool"), F.when(low == "high", "error").when(low == "medium", "warning").otherwise("info").alias("severity"), F.coalesce(F.nullif("r.issue_text", F.lit("")), "r.issue_confidence", F.lit("")).alias("message"), F.col("r.filename").alias("file"), safe_int(F.col("r.line_number")).alias("line"), F.lit(None).cast("int").alias("column"), F.col("r.more_info").alias("suggestion"))


def parsed_eslint(reports: DataFrame, text: str, *keys: str) -> DataFrame:
    files = reports.select(*keys, F.posexplode(F.from_json(F.col(text), ESLINT)).alias("_f", "_file"))
    rows = files.select(*keys, "_f", F.coalesce("_file.filePath", "_file.file").alias("_path"), F.posexplode("_file.messages").alias("_m", "r"))
    return rows.select(*keys, (F.col("_f") * 100_000 + F.col("_m")).cast("long").alias("ordinal"), F.concat(F.lit("eslint:"), F.coalesce(F.nullif("r.ruleId", F.lit("")), F.lit("unknown"))).alias("id"), F.lit("eslint").alias("tool"), F.when(F.col("r.severity") == 2, "error").otherwise("warning").alias("severity"), F.col("r.message").alias("message"), F.col("_path").alias("file"), safe_int(F.col("r.line")).alias("line"), safe_int(F.col("r.column")).alias("column"), F.lit(None).cast("string").alias("suggestion"))


def parsed_all(reports: DataFrame, *keys: str, tool: str = "tool", text: str = "stdout") -> DataFrame:
    """The findings of a table of reports (tool, text), each by its tool's format; unknown tools by the generic one.

    Reports of lines are split once and read in one pass; only those in JSON are branches of their own.
    """
    name = F.col(tool)
    kind = F.when(name.isin([t for t in LINES if t != "generic"]), name).otherwise("generic")
    rows = reports.where(~F.coalesce(name.isin("bandit", "eslint"), F.lit(False))).select(*keys, kind.alias("_kind"), F.coalesce(text, F.lit("")).alias("_text"))
    lines = rows.select(*keys, "_kind", F.posexplode(F.split("_text", "\r\n|\n|\r")).alias("ordinal", "raw")).withColumn("raw", F.trim("raw"))
    fields = F
    for t in LINES:
        fields = fields.when((F.col("_kind") == t) & F.col("raw").rlike(LINES[t]), F.struct(*[c.alias(n) for n, c in _finding(t, F.col("raw"), "generic").items()]))
    found = lines.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), fields.alias("_f")).where("_f IS NOT NULL").select(*keys, "ordinal", "_f.*")
    return found.unionByName(parsed_bandit(reports.where(name == "bandit"), text, *keys)).unionByName(parsed_eslint(reports.where(name == "eslint"), text, *keys))


def file_reports(files: DataFrame, findings: DataFrame, by: str = "path") -> DataFrame:
    """Each file with its counts and status; a file without findings is ok."""
    counted = summary(capped(findings, by), by).withColumnRenamed(by, "_by")
    joined = files.join(counted, F.col(by) == F.col("_by"), "left").drop("_by")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings", "info")} | {"status": F.coalesce("status", F.lit("ok"))})


DANGEROUS = ASCII_EDGE + r"(?:eval|exec|system|popen|ProcessBuilder)" + ASCII_EDGE


def internal(tool: str, message: Column, severity: str = "error") -> Column:
    null = F.lit(None)
    return F.struct(F.lit(f"internal:{tool}").alias("id"), F.lit(tool).alias("tool"), F.lit(severity).alias("severity"), message.alias("message"), null.cast("string").alias("file"), null.cast("int").alias("line"), null.cast("int").alias("column"), null.cast("string").alias("suggestion"))


def capped(findings: DataFrame, by: str = "path", cap: int = CAP) -> DataFrame:
    """The first of equal findings (tool, message, file, line, column) of each path, `cap` at most; by ordinal."""
    key = [by, "tool", "message", "file", "line", "column"]
    first = findings.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {', '.join(f'`{k}`' for k in key)} ORDER BY ordinal)")).where("_k = 1")
    return first.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY `{by}` ORDER BY ordinal)")).where(F.col("_k") <= cap).drop("_k")


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """errors, warnings, info and status of each group; every other severity is info."""
    s = F.coalesce("severity", F.lit("info"))
    rows = findings.groupBy(*by).agg(F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(~s.isin("error", "warning")).alias("info"))
    return rows.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "partial").otherwise("ok"))


def overall(files: DataFrame) -> DataFrame:
    return files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("errors", "warnings", "info")], F.count("*").alias("files_validated"))


def truncated(text: Column, limit: int = RAW_LIMIT) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncated_bytes(text: Column, limit: int = 200 * 1024) -> Column:
    """At most limit bytes of UTF-8; a character that the cut splits becomes the replacement character."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit("\n...[truncated]"))).otherwise(text)


def run_status(timed_out: Column, killed: Column, exit_code: Column, language: Column, stderr: Column) -> Column:
    low = F.lower(stderr)
    compiled = language.isin("c", "cpp", "java", "rust") & (low.contains("error") | low.contains("undefined reference"))
    return F.when(timed_out, "timeout").when(killed | exit_code.isNull(), "sandbox_error").when(exit_code == 0, "success").when(compiled, "compile_error").otherwise("test_failure")


#: What is fixed in Python code.
BARE_EXCEPT, REQUEST, SPELT_INIT = r"(?m)(^\s*)except\s*:\s*$", r"(requests\.(?:get|post)\s*\([^)\n]*\))", r"def\s+_init_\s*\("


def fixed_python(code: Column) -> Column:
    """Bare excepts named, timeouts added to requests calls that have none, _init_ spelt out."""
    named = F.regexp_replace(code, BARE_EXCEPT, "$1except Exception as e:")
    call = F.regexp_replace
    timed = relabelled(named, REQUEST, 1, lambda g: F.when(g[0].contains("timeout="), g[0]).otherwise(call(g[0], r"\)\s*$", ", timeout=10)")))
    return F.regexp_replace(timed, SPELT_INIT, "def __init__(")


#: What ends a line, and how a diff names its two sides.
ENDS, SIDES = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029", ("--- original", "+++ suggested")


def lines(text: Column) -> Column:
    """array<string>: the lines of a text with their ends."""
    return F.regexp_extract_all(text, F.lit(f"[^{ENDS}]*+(?:\\r\\n|[{ENDS}])|[^{ENDS}]++"), F.lit(0))


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with in common."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a))


def _rising(pairs: Column) -> Column:
    """The longest run of pairs (i, j), given by ascending i, in which j rises too."""

    def step(at: Column, x: Column) -> Column:
        k, held = F.size(at["back"]), F.size(F.filter(at["tails"], lambda t: t["j"] < x["j"]))
        back = F.when(held > 0, F.get(at["tails"], held - 1)["k"]).otherwise(-1)
        tails = F.concat(F.slice(at["tails"], 1, held), F.array(F.struct(k.alias("k"), x["j"].alias("j"))), F.slice(at["tails"], held + 2, F.size(at["tails"])))
        return F.struct(tails.alias("tails"), F.concat(at["back"], F.array(back)).alias("back"))

    begun = F.struct(F.array().cast("array<struct<k:int,j:int>>").alias("tails"), F.array().cast("array<int>").alias("back"))

    def walked(at: Column) -> Column:
        last = F.struct(F.get(at["tails"], F.size(at["tails"]) - 1)["k"].alias("k"), F.array().cast("array<int>").alias("chosen"))
        back = F.aggregate(at["tails"], last, lambda w, _: F.struct(F.get(at["back"], w["k"]).alias("k"), F.concat(w["chosen"], F.array(w["k"])).alias("chosen")), lambda w: F.reverse(w["chosen"]))
        return F.transform(back, lambda k: F.get(pairs, k))

    return F.aggregate(pairs, begun, step, walked)


CHANGE = "struct<i:int,n:int,j:int,m:int>"


def changes(files: DataFrame, *keys: str, before: str = "before", after: str = "after") -> DataFrame:
    """key: struct of keys, a, b, changes of each file's two texts.

    a and b are the lines, changes an array<struct<i, n, j, m>> in order: after i lines of a, n of them give way to the m
    lines that follow j lines of b; texts that differ by white space at their ends only have none. What both begin and end with is laid aside. Lines that the rest of
    either side holds just once are its anchors: they are found by one aggregation over lines, and of those the longest run
    that is in order on both sides stays. Between two anchors, what is equal next to them stays too. An empty or null text
    has no lines. Rows with the same keys and texts have no anchors: their
    changes are right but wider.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    of = ["key", "texts"]
    same = (stripped(text(before)) == stripped(text(after))).alias("same")
    rows = files.select(F.struct(*keys).alias("key"), F.xxhash64(text(before), text(after)).alias("texts"), same, lines(text(before)).alias("a"), lines(text(after)).alias("b"))
    rows = rows.withColumn("head", _alike(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c))
    rows = rows.withColumn("tail", _alike(F.reverse(rest("a")), F.reverse(rest("b"))))
    places = lambda c: F.transform(F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail")), lambda x, i: F.struct(x.alias("line"), (i + F.col("head")).alias("at"), F.lit(c).alias("side")))
    # no filter: it would be pushed below a repartition, and the texts made there too
    held = rows.select(*of, F.explode(F.when(~F.col("same"), F.concat(places("a"), places("b")))).alias("x")).groupBy(*of, F.col("x.line").alias("line"))
    mine = lambda side: F.count(F.when(F.col("x.side") == side, 1)) == 1
    once = held.agg(mine("a").alias("in_a"), mine("b").alias("in_b"), F.count("*").alias("c"), F.min(F.when(F.col("x.side") == "a", F.col("x.at"))).alias("i"), F.min(F.when(F.col("x.side") == "b", F.col("x.at"))).alias("j"))
    once = once.where("in_a AND in_b AND c = 2").groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("pairs"))
    # an anchor before and behind the rest, where its ends are
    last = F.array(F.struct((F.size("a") - F.col("tail")).alias("i"), (F.size("b") - F.col("tail")).alias("j")))
    rows = rows.join(once, of, "left").withColumn("stops", F.concat(F.when(F.col("pairs").isNotNull(), _rising(F.col("pairs"))).otherwise(F.array().cast("array<struct<i:int,j:int>>")), last))

    def gap(stop: Column, at: Column) -> Column:
        """What differs between the anchor before (or the head's end) and this one."""
        i = F.when(at == 0, F.col("head")).otherwise(F.get("stops", at - 1)["i"] + 1)
        j = F.when(at == 0, F.col("head")).otherwise(F.get("stops", at - 1)["j"] + 1)
        return let(F.struct(i.alias("i"), j.alias("j"), F.slice("a", i + 1, stop["i"] - i).alias("x"), F.slice("b", j + 1, stop["j"] - j).alias("y")), shrunk)

    def shrunk(g: Column) -> Column:
        return let(_alike(g["x"], g["y"]), lambda p: let(_alike(F.reverse(F.slice(g["x"], p + 1, F.size(g["x"]))), F.reverse(F.slice(g["y"], p + 1, F.size(g["y"])))), lambda q: F.struct((g["i"] + p).alias("i"), (F.size(g["x"]) - p - q).alias("n"), (g["j"] + p).alias("j"), (F.size(g["y"]) - p - q).alias("m"))))

    found = F.filter(F.transform("stops", gap), lambda c: (c["n"] > 0) | (c["m"] > 0))
    return rows.select("key", "a", "b", F.when(F.col("same"), F.array().cast(f"array<{CHANGE}>")).otherwise(found).alias("changes"))


def diffs(files: DataFrame, *keys: str, before: str = "before", after: str = "after", context: int = 3) -> DataFrame:
    """keys, diff: a unified diff of each file's texts; empty for texts that differ by white space at their ends only.

    Lines keep their ends and are joined by line feeds; changes at most 2 * context lines apart share a hunk. See changes().
    """
    rows = changes(files, *keys, before=before, after=after)

    def grouped(hunks: Column, c: Column) -> Column:
        last = F.element_at(hunks, -1)
        end = let(F.element_at(last, -1), lambda x: x["i"] + x["n"])
        near = (F.size(hunks) > 0) & (c["i"] - end <= 2 * context)
        return F.when(near, F.concat(F.slice(hunks, 1, F.size(hunks) - 1), F.array(F.concat(last, F.array(c))))).otherwise(F.concat(hunks, F.array(F.array(c))))

    def span(start: Column, n: Column) -> Column:
        return F.concat((start + F.when(n == 0, 0).otherwise(1)).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))

    def part(sign: str, of: str, start: Column, n: Column) -> Column:
        return F.transform(F.slice(of, start + 1, F.greatest(n, F.lit(0))), lambda x: F.concat(F.lit(sign), x))

    def hunk(h: Column) -> Column:
        first, last = F.get(h, F.lit(0)), F.element_at(h, -1)
        before_it = F.least(first["i"], F.lit(context))
        behind = F.least(F.size("a") - last["i"] - last["n"], F.lit(context))
        a, b = first["i"] - before_it, first["j"] - before_it
        title = F.concat(F.lit("@@ -"), span(a, last["i"] + last["n"] + behind - a), F.lit(" +"), span(b, last["j"] + last["m"] + behind - b), F.lit(" @@"))

        def shown(c: Column, at: Column) -> Column:
            since = F.when(at == 0, a).otherwise(let(F.get(h, at - 1), lambda x: x["i"] + x["n"]))
            return F.concat(part(" ", "a", since, c["i"] - since), part("-", "a", c["i"], c["n"]), part("+", "b", c["j"], c["m"]))

        return F.concat(F.array(title), F.flatten(F.transform(h, shown)), part(" ", "a", last["i"] + last["n"], behind))

    hunks = F.aggregate("changes", F.array().cast(f"array<array<{CHANGE}>>"), grouped)
    text = F.array_join(F.concat(F.array(*map(F.lit, SIDES)), F.flatten(F.transform(hunks, hunk))), "\n")
    return rows.select("key", F.when(F.size("changes") > 0, text).otherwise("").alias("diff")).select("key.*", "diff")


#: What a finding of the syntax tree says: id, severity, message, suggestion.
SYNTAX = ("ast:syntax", "error", "SyntaxError: {}", "Fix syntax error.")
EVAL = ("ast:insecure-eval", "error", "Use of {}() is insecure.", "Avoid eval/exec; validate inputs and avoid dynamic execution.")
BARE = ("ast:bare-except", "warning", "Bare except detected (catching all exceptions).", "Catch specific exceptions or use `except Exception as e`.")
#: The same of code in no known language.
HEURISTIC = ("heuristic:exec", "warning", "Potential use of dangerous execution functions detected.", "Review code for unsafe execution of shell/strings.")

FINDING = "struct<ordinal:long,id:string,tool:string,severity:string,message:string,file:string,line:int,column:int,suggestion:string>"


def _tree_findings(code: str | None, file: str | None) -> list[tuple]:
    out: list[tuple] = []

    def add(kind: tuple, what: str, at: str | None, line: int | None, column: int | None) -> None:
        out.append((len(out), kind[0], "ast", kind[1], kind[2].format(what), at, line, column, kind[3]))

    try:
        tree = ast.parse(code or "")
    except SyntaxError as e:
        add(SYNTAX, e.msg, e.filename or file, e.lineno, e.offset)
        return out
    except (ValueError, RecursionError, MemoryError) as e:  # null bytes, nesting
        return [(0, "internal:ast", "ast", "error", f"AST analyzer crashed: {e}", None, None, None, None)]
    for node in ast.walk(tree):
        match node:
            case ast.Call(func=ast.Name(id="eval" | "exec" as name)):
                add(EVAL, name, file, node.lineno, None)
            case ast.ExceptHandler(type=None):
                add(BARE, "", file, node.lineno, None)
    return out


def _checked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for codes, files in batches:
        yield pd.Series([_tree_findings(c, f) for c, f in zip(codes, files, strict=True)], dtype=object)


def ast_checks(code: Column, file: Column | None = None) -> Column:
    """array of findings: syntax errors, calls of eval and exec, and bare excepts of Python code."""
    return F.pandas_udf(_checked, f"array<{FINDING}>")(code, F.lit(None).cast("string") if file is None else file)


def ast_findings(files: DataFrame, *keys: str, code: str = "content", file: str = "path") -> DataFrame:
    """keys, ordinal and a finding's columns of each file of Python code."""
    return files.select(*keys, F.explode(ast_checks(F.col(code), F.col(file).cast("string"))).alias("f")).select(*keys, "f.*")


def heuristic_findings(files: DataFrame, *keys: str, code: str = "content", file: str = "path") -> DataFrame:
    """The same of code in no known language."""
    name, severity, message, suggestion = HEURISTIC
    null = F.lit(None).cast("int")
    return files.where(F.col(code).rlike(DANGEROUS)).select(*keys, F.lit(0).cast("long").alias("ordinal"), F.lit(name).alias("id"), F.lit("heuristic").alias("tool"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.col(file).cast("string").alias("file"), null.alias("line"), null.alias("column"), F.lit(suggestion).alias("suggestion"))


def tool_results(runs: DataFrame, *keys: str, tool: str = "tool", result: str = "result") -> DataFrame:
    """keys, tool, stdout, stderr, exit_code, diagnostics of what ran: struct<stdout, stderr, exit_code, returncode>, null where nothing usable came back."""
    r, none = F.col(result), F.col(result).isNull()
    text = lambda f: F.when(none, "").otherwise(F.coalesce(r[f], F.lit("")))
    stderr = F.when(none, F.concat(F.lit("Invalid sandbox result type for "), tool)).otherwise(text("stderr"))
    code = F.when(none, -1).otherwise(F.coalesce(r["exit_code"], r["returncode"], F.lit(0)))
    return runs.select(*keys, tool, text("stdout").alias("stdout"), stderr.alias("stderr"), code.cast("int").alias("exit_code"), F.when(none, "invalid-result-type").alias("diagnostics"))


def validated(files: DataFrame, reports: DataFrame | None = None, path: str = "path", code: str = "content") -> DataFrame:
    """path, language, errors, warnings, info, status, findings of each file (path, code): what its language's checks say.

    reports: output of tools (path, tool, stdout) to be read too. The findings of a file are in order, each once, CAP at most.
    """
    from umbra.operators.abstraction import language8  # it knows languages, this module findings

    known = files.select(path, code, language8(F.col(code), F.col(path)).alias("language"))
    found = ast_findings(known.where("language = 'python'"), path, code=code, file=path)
    found = found.unionByName(heuristic_findings(known.where("language = 'unknown'"), path, code=code, file=path))
    if reports is not None:
        found = found.unionByName(parsed_all(reports, path).withColumn("ordinal", F.col("ordinal") + 1_000_000))
    kept = capped(found, path)
    lists = kept.groupBy(F.col(path).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "tool", "severity", "message", "file", "line", "column", "suggestion"))).alias("findings"))
    counted = file_reports(known.select(path, "language"), kept, path)
    return counted.join(lists, F.col(path) == F.col("_p"), "left").drop("_p").withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))


def validated_code(spark: SparkSession, code: str, name: str | None = None) -> DataFrame:
    """The report of one piece of code, which may have a file's name."""
    return validated(spark.createDataFrame([(name or "snippet", code)], "path string, content string"))


def validated_path(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """The report of each code file below a folder, and one row: errors, warnings, info, files_validated, note, error.

    A folder that isn't there is an error and has no report; one without code files has zeros and a note.
    """
    from pyspark.errors import AnalysisException

    from umbra.sources.readers import source_tree

    try:
        files = source_tree(spark, root, include, exclude)
    except AnalysisException:
        zero = [F.lit(0).cast("long").alias(c) for c in ("errors", "warnings", "info", "files_validated")]
        return None, spark.range(1).select(*zero, F.lit(None).cast("string").alias("note"), F.lit(f"Path not found: {root}").alias("error"))
    reports = validated(files.select("path", "content"))
    whole = overall(reports).withColumns({"note": F.when(F.col("files_validated") == 0, "No discoverable files."), "error": F.lit(None).cast("string")})
    return reports, whole
