"""The whole way of a source file to safe text and back: redact, abstract, verify, release or block, restore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.patterns import let
from umbra.operators import abstraction as A
from umbra.operators import redaction as R
from umbra.operators.restoring import opened
from umbra.sources.folders import Rounds

MASK = "__MASK_"


#: Language -> the words that its abstraction skips; a language that isn't listed is abstracted as "unknown". Others can be added.
REGISTRY: dict[str, str] = {"javascript": "javascript", "typescript": "javascript", "java": "javascript", "python": "python"}
MAPPING = "array<struct<kind:string,original:string,placeholder:string>>"

#: From code, whose secrets are masked, and its path to a struct<safe: string, mapping: MAPPING, error: string>.
Pass = Callable[[Column, Column], Column]
#: Language -> a pass of its own in place of the ones that are here. Others can be added; protect() takes more for one call.
PASSES: dict[str, Pass] = {}
FAILED = "the pass of the language gave no text"


def _own(passes: dict[str, Pass], language: Column, code: Column, path: Column) -> Column:
    """What the pass of each row's language gives; null where a language has none."""
    out = F
    for name, of in passes.items():
        given = let(of(code, path), lambda r: F.struct(r["safe"].alias("safe"), F.coalesce(r["mapping"], F.array()).cast(MAPPING).alias("mapping"), F.coalesce(r["error"], F.when(r["safe"].isNull(), FAILED)).alias("error")))
        out = out.when(language == name, given)
    return out.otherwise(F.lit(None))


def protect(corpus: DataFrame, allow: list[str] | None = None, salt: str = R.DEFAULT_SALT, mode: str = "strict", redaction: str = "reference", digits: int = A.DIGITS, unique: bool = False, passes: dict[str, Pass] | None = None) -> DataFrame:
    """path, language, safe, secrets, mapping, error of a corpus (path, content); safe is null where error isn't.

    The corpus is read and redacted once. Code in a language without a parser is abstracted by native expressions, Python
    by its syntax tree in an Arrow function and then by the same expressions, which hide attributes and imports too. mode
    "lenient" abstracts strings, numbers and comments of Python that can't be parsed instead of blocking it, and verifies
    nothing. digits: hexadecimal digits of a label. unique: originals of the corpus whose labels are equal get _1, _2 and so
    on behind them, the same in every file; this reads the scanned corpus again, from the shared folder.

    passes: more passes of languages (see PASSES), also of those that only the wider detection knows. Their labels have the
    form of label(), and unique leaves them. What they map must be gone from the text, as with the others; what they leave
    is theirs to say. Python that its own pass fails on is blocked; code of another language is then that of an unknown one.
    """
    keep = allow or []
    passes = PASSES | (passes or {})
    rows = corpus.select("path", R.redacted(F.col("content"), salt, redaction).alias("r")).select("path", "r.secrets", A.masked(F.col("r.text")).alias("masked"))
    rows = rows.withColumn("language", A.language4(F.col("masked"), F.col("path")))
    python, own, reads = F.col("language") == "python", F.lit(False), F.col("language")
    if passes:
        wide = A.language8(F.col("masked"), F.col("path"))
        rows = rows.withColumn("language", F.when(wide.isin(*passes) & ~F.col("language").isin(*passes), wide).otherwise(F.col("language")))
        rows = rows.withColumn("own", _own(passes, F.col("language"), F.col("masked"), F.col("path")))
        own = F.col("own").isNotNull() & F.col("own.error").isNull()
        reads = F.when(F.col("own.error").isNotNull(), "unknown").otherwise(F.col("language"))
        python = python & F.lit("python" not in passes)
    # the function sees code of other languages as null and leaves it
    rows = rows.withColumn("p", A.python_abstractor(salt, tuple(keep), "paranoid").asNondeterministic()(F.when(python, F.col("masked"))))
    code = F.when(python, F.col("p.abstracted")).when(own, "").otherwise(F.col("masked"))
    tree = F.when(python, F.transform(F.map_entries("p.mapping"), lambda e: F.struct(F.lit("AST").alias("kind"), e["key"].alias("original"), e["value"].alias("placeholder"))))
    failure = F.when(python, F.col("p.error"))
    if "python" in passes:
        failure = F.when(F.col("language") == "python", F.col("own.error"))
    rows = rows.withColumns({"code": code, "failed": failure, "tree": F.coalesce(tree, F.array().cast(MAPPING))})

    # the skip list of a language is chosen word by word, so that there is one scan for all of them
    kinds = {kind: [n for n, k in REGISTRY.items() if k == kind] for kind in sorted({*REGISTRY.values()})}

    def stays(x: Column) -> Column:
        known = F
        for kind, names in kinds.items():
            known = known.when(reads.isin(*names), x.isin(*A.skip_words(kind), *keep))
        return known.otherwise(x.isin(*A.skip_words("unknown"), *keep)) | x.startswith(MASK)

    plain = lambda kind, x: A.label(kind, x, salt, digits)
    named = plain
    if unique:
        rows = _with_suffixes(rows, stays, salt, digits)
        named = lambda kind, x: F.concat(plain(kind, x), F.coalesce(F.try_element_at("suffixes", F.concat(F.lit(f"{kind}:"), x)), F.lit("")))
    rows = rows.withColumn("f", A.folded(F.col("code"), stays, salt, named))
    found = let(F.col("f.entries"), lambda e: A.mapped(e, salt, named))
    failed, lenient = F.col("failed").isNotNull(), mode == "lenient"
    weak, rest = F.lit(None).cast("string"), F.array().cast(MAPPING)
    if lenient:
        weak = A.comments(A.numbers(A.strings(F.col("masked"), salt), salt), salt)
        rest = F.filter(A.mapping(F.col("masked"), "python", keep, salt, MASK), lambda m: m["kind"] != "IDENT")
    out = rows.select(
        "path", "secrets", "masked", "language",
        F.when(own, F.col("own.safe") if passes else None).when(failed, weak).otherwise(F.col("f.safe")).alias("safe"),
        F.when(own, F.col("own.mapping") if passes else None).when(failed, rest).otherwise(F.concat("tree", found)).alias("mapping"),
        (F.lit(None).cast("string") if lenient else F.col("failed")).alias("error"), own.alias("own"),
    )
    if mode != "lenient":
        out = _verified(out, keep)
    # each secret's mask once a row; few of the originals hold one
    masks = F.array_distinct(F.transform("secrets", lambda s: F.struct(A.masked(s["placeholder"]).alias("mask"), s["placeholder"].alias("label"))))
    unmasked = lambda x, of: F.when(F.contains(x, F.lit(MASK)), F.aggregate(of, x, lambda t, m: F.replace(t, m["mask"], m["label"]))).otherwise(x)
    # let() holds what a lambda uses: a column would be put into it and computed for each element
    opened = let(masks, lambda of: F.transform("mapping", lambda m: F.struct(m["kind"].alias("kind"), unmasked(m["original"], of).alias("original"), m["placeholder"].alias("placeholder"))))
    out = out.withColumns({"safe": let(F.col("safe"), lambda t: unmasked(t, masks)), "mapping": opened})
    survived = let(F.col("safe"), lambda t: F.exists("secrets", lambda s: (F.length(s["value"]) >= 8) & F.contains(t, s["value"])))
    out = out.withColumn("error", F.coalesce("error", F.when(survived, "a secret survived")))
    return out.select("path", "language", F.when(F.col("error").isNull(), F.col("safe")).alias("safe"), "secrets", "mapping", "error")


def _with_suffixes(rows: DataFrame, stays: Callable[[Column], Column], salt: str, digits: int) -> DataFrame:
    """rows with suffixes: of what a file holds, that which shares its label with something else of the corpus.

    Comments hold labels, so theirs follow once the others are settled.
    """
    rounds = Rounds(rows.sparkSession, "protect")
    rows = rounds.kept(rows.withColumn("suffixes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    named = lambda kind, x: F.concat(A.label(kind, x, salt, digits), F.coalesce(F.try_element_at("suffixes", F.concat(F.lit(f"{kind}:"), x)), F.lit("")))
    for kinds in (("STRING", "NUMBER", "IDENT"), ("COMMENT",)):
        entries = rounds.kept(rows.select("path", F.explode(F.array_distinct(A.folded(F.col("code"), stays, salt, named)["entries"])).alias("e")).select("path", "e.*").where(F.col("kind").isin(*kinds)))
        shared = rounds.kept(A.shared_labels(entries, salt, digits, kinds))
        if not shared.isEmpty():
            more = A.suffixes_of(entries, shared, "path").withColumnRenamed("suffixes", "more")
            rows = rounds.kept(rows.join(more, "path", "left").withColumn("suffixes", F.when(F.col("more").isNull(), F.col("suffixes")).otherwise(F.map_concat("suffixes", "more"))).drop("more"), rows)
        rounds.dropped(entries, shared)
    return rows


def _verified(rows: DataFrame, keep: list[str]) -> DataFrame:
    """error where an identifier of unparsed code wasn't mapped (own: a pass that says itself what it leaves), or a mapped one stands in the safe text."""
    skip = [*A.skip_words("unknown"), *keep]
    names = F.transform("mapping", lambda m: m["original"])
    found = F.filter(A.harvested(F.col("masked"), skip), lambda x: ~x.startswith(MASK))
    unmapped = F.size(F.array_except(found, names))
    plain = F.filter(names, lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~x.isin(*skip))
    error = F.when((F.col("language") != "python") & ~F.col("own") & (unmapped > 0), F.concat(unmapped.cast("string"), F.lit(" identifier(s) unabstracted"))).when(F.arrays_overlap(plain, A.visible(F.col("safe"))), "an identifier is visible")
    return rows.withColumn("error", F.coalesce("error", error))


def reopened(safe: Column, mapping: Column, secrets: Column) -> Column:
    """Safe text with its originals; a label that stands in the original of another one is opened too."""
    pairs = F.transform(mapping, lambda m: F.struct(m["placeholder"].alias("placeholder"), m["original"].alias("value"), F.lit(True).alias("nests")))
    plain = F.transform(secrets, lambda s: F.struct(s["placeholder"].alias("placeholder"), s["value"].alias("value"), F.lit(False).alias("nests")))
    return opened(safe, F.concat(pairs, plain))


def written_back(answers: DataFrame, protected: DataFrame) -> DataFrame:
    """path, content of answers (path, safe) to files that were read before; others have no mapping and are left out."""
    known = protected.where("error IS NULL").select("path", "mapping", "secrets")
    return answers.join(known, "path").select("path", reopened(F.col("safe"), F.col("mapping"), F.col("secrets")).alias("content"))


def saved(answers: DataFrame, protected: DataFrame, folder: str) -> None:
    """written_back() as a table (path, content) in a folder, over what was there."""
    written_back(answers, protected).write.mode("overwrite").parquet(folder)


def shown_to_model(protected: DataFrame) -> DataFrame:
    """path, body: a header with counts and the safe text, or why the file is blocked."""
    header = F.concat(F.lit("secrets hidden: "), F.size("secrets"), F.lit(", names hidden: "), F.size("mapping"), F.lit("\n\n"), F.col("safe"))
    return protected.select("path", F.when(F.col("error").isNull(), header).otherwise(F.concat(F.lit("blocked: "), F.col("error"))).alias("body"))


#: How the tests of a language are run.
COMMANDS = {
    "python": "pytest -q . || python -m unittest discover -v || python test_code.py",
    "javascript": "npx jest --runInBand || npx mocha || node test_code.js",
    "typescript": "npx jest --runInBand || npx mocha || node test_code.js",
    "java": "mvn -q test || gradle test --quiet || javac TestCode.java && java TestCode",
    "go": "go test ./... || go test || go run .",
    "rust": "cargo test --quiet || rustc --edition=2021 tests.rs && ./tests || true",
    "cpp": "g++ -std=c++17 test_code.cpp -O2 -o test_code && ./test_code",
}
NO_COMMAND = "echo 'No runner configured for language' && exit 2"
#: The file of a language's placeholder test.
TEST_FILES = {"python": "test_code.py", "javascript": "test_code.js", "typescript": "test_code.js", "java": "TestCode.java", "go": "main_test.go", "rust": "tests.rs", "cpp": "test_code.cpp"}
#: A test of each language that only shows that the code loads and that its runner works.
TESTS = {
    "python": "import importlib\n\nmodule = importlib.import_module('code')\n\n\ndef test_placeholder():\n    assert module is not None\n",
    "javascript": "const assert = require('assert');\nassert(require('./code') !== undefined);\n",
    "java": "class TestCode {\n    public static void main(String[] args) {\n        System.out.println(\"placeholder ok\");\n    }\n}\n",
    "go": "package main\n\nimport \"testing\"\n\nfunc TestPlaceholder(t *testing.T) {}\n",
    "rust": "#[test]\nfn placeholder() {\n    assert!(true);\n}\n",
    "cpp": "#include <iostream>\n\nint main() {\n    std::cout << \"placeholder ok\" << std::endl;\n}\n",
}


def _of(table: dict[str, str], language: Column, otherwise: str) -> Column:
    name = F.coalesce(F.nullif(F.lower(language), F.lit("")), F.lit("python"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), F.lit(otherwise))


def test_command(language: Column) -> Column:
    """The shell command that runs a language's tests; null is Python."""
    return _of(COMMANDS, language, NO_COMMAND)


def placeholder_test(language: Column) -> Column:
    """struct<file, content> of a test for code that has none; null is Python."""
    return F.struct(_of(TEST_FILES, language, "test_placeholder.txt").alias("file"), _of(TESTS | {"typescript": TESTS["javascript"]}, language, "placeholder").alias("content"))


test_command.__test__ = False
