"""Files out of a model's answer, as expressions: JSON, marked blocks, loose marks, bare fences or code as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.patterns import let, marked, matched
from umbra.operators.text import normalised, stripped

#: The format of a file in an answer. A language stands on the fence's own line.
FENCE_BODY = r"```[^\S\n]*[\w+.#-]*\n((?s:.*?))\n```"
MARK = r"\*\*File:\s*([^\n]*?)\*\*\s*"
LOOSE_MARK = r"File:[^\S\n]*(\S[^\n]*?)"
NEAR_MARK = r"(?i)File:\s*([^\n*`]+)"
PATH_NAME = r"([A-Za-z0-9_\-./\\]+?\.(?:py|js|ts|java|go|rs|cpp|c|html|css|json|yaml|yml|md))"
NEAR = 200
#: An answer that holds one of these is code, if it names no file.
CODE_SIGNS = ["def ", "class ", "import ", "{", ";", "function ", "package ", "pub "]
#: Names of a file that has none.
ONLY, NUMBERED = "<file>", "<file_"

FILES = "map<string,string>"


def balanced(text: Column) -> Column:
    """array<string>: the outermost stretches from an opening bracket to where as many have been closed, of either kind."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\[\]{}]|[^\[\]{}]+"), F.lit(0))
    none = F.array().cast("array<string>")
    begun = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), none.alias("done"))

    def step(a: Column, x: Column) -> Column:
        up, down = x.isin("{", "["), x.isin("}", "]")
        depth = a["depth"] + F.when(up, 1).when(down & (a["depth"] > 0), -1).otherwise(0)
        held = F.when(up | (a["depth"] > 0), F.concat(a["open"], x)).otherwise("")
        closed = down & (a["depth"] == 1)
        return F.struct(depth.alias("depth"), F.when(closed, "").otherwise(held).alias("open"), F.when(closed, F.concat(a["done"], F.array(held))).otherwise(a["done"]).alias("done"))

    return F.aggregate(pieces, begun, step, lambda a: a["done"])


def found_json(text: Column) -> Column:
    """The first of these that is JSON: the text, a fenced object, a balanced part, the widest braces; else null."""
    def of(t: Column) -> Column:
        fences = F.filter(F.split(t, "```", -1), lambda x, i: i % 2 == 1)
        objects = F.filter(F.transform(fences, lambda x: stripped(F.regexp_replace(x, "(?i)^json", ""))), lambda x: x.startswith("{") & x.endswith("}"))
        widest = F.array(F.regexp_extract(t, r"(?s)\{.*\}", 0))
        tried = F.concat(F.array(t), F.slice(objects, 1, 1), balanced(t), widest)
        return F.get(F.filter(tried, lambda x: F.try_parse_json(x).isNotNull() & (stripped(x) != "null")), F.lit(0))

    return let(F.coalesce(text, F.lit("")), of)


def _map(entries: Column, last: bool = True) -> Column:
    """array<struct<path, code>> as a map; of a path given twice the last or first counts. Paths are trimmed, empty ones left out."""
    def once(e: Column) -> Column:
        paths = F.transform(e, lambda x: x["path"])
        ranked = F.reverse(paths) if last else paths
        place = lambda x: F.array_position(ranked, x["path"]).cast("int")
        return F.filter(e, lambda x, i: (i == F.size(e) - place(x)) if last else (i == place(x) - 1))

    return F.map_from_entries(let(F.filter(entries, lambda x: x["path"] != ""), once))


def _entry(path: Column, code: Column) -> Column:
    return F.struct(path.alias("path"), normalised(code).alias("code"))


def _blocks(text: Column, mark: str, separated: str = "") -> Column:
    pattern = mark + separated + FENCE_BODY
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("c"))
    return F.transform(found, lambda x: _entry(stripped(F.regexp_replace(stripped(x["p"]), r"^\*+|\*+$", "")), x["c"]))


def _fences(text: Column) -> Column:
    """Fences with the path that is named within NEAR characters before, or a number."""
    def of(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(matched(x)[0].alias("found"), matched(x)[1].alias("tail")))
        begun = F.struct(F.length(parts[0]).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(rest, begun, lambda a, x: F.struct((a["at"] + F.length(x["found"][0]) + F.length(x["tail"])).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        return let(F.arrays_zip(rest.alias("f"), starts.alias("at")), lambda z: F.transform(z, one))

    def one(x: Column, i: Column) -> Column:
        before = F.substring(text, F.greatest(x["at"] - NEAR, F.lit(0)) + 1, F.least(x["at"], F.lit(NEAR)))
        name = F.coalesce(*[F.nullif(stripped(F.regexp_replace(F.regexp_extract(before, p, 1), r"^\*+|\*+$", "")), F.lit("")) for p in (NEAR_MARK, PATH_NAME)])
        return _entry(F.coalesce(name, F.concat(F.lit(NUMBERED), i.cast("string"), F.lit(">"))), x["f"]["found"][1])

    return let(marked(text, f"({FENCE_BODY})", 2), of)


def parsed_files(answer: Column) -> Column:
    """map<path, code> of an answer; of the forms the first that gives a file counts, and no form gives an empty map.

    Null and blank answers have no file. Code ends in a new line. JSON: `files` (path to code) or `code`.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def whole(t: Column) -> Column:
        return let(found_json(t), lambda j: let(F.from_json(j, "struct<files:map<string,string>,code:string>"), lambda d: cascade(t, j, d)))

    def cascade(t: Column, j: Column, d: Column) -> Column:
        # only an object has files; only a string is code
        text_code = F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), "$.code", "variant")) == "STRING"
        files = F.transform(F.map_entries(d["files"]), lambda e: _entry(stripped(e["key"]), F.coalesce(e["value"], F.lit("None"))))
        some = lambda m: F.when(F.size(m) > 0, m)
        code = F.exists(F.array(*map(F.lit, CODE_SIGNS)), lambda s: F.contains(t, s))
        return F.coalesce(
            F.when(d["files"].isNotNull(), _map(files)),
            F.when(text_code, F.create_map(F.lit(ONLY), normalised(d["code"]))),
            some(_map(_blocks(t, MARK))),
            some(_map(_blocks(t, LOOSE_MARK, r"\n"), last=False)),
            some(_map(_fences(t))),
            F.when(code, F.create_map(F.lit(ONLY), normalised(t))),
            none,
        )

    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", none).otherwise(let(stripped(answer), whole))


def first_errors(findings: DataFrame, *by: str) -> DataFrame:
    """message: of each group's findings the first that is an error, by ordinal; groups without one are left out."""
    return findings.where("severity = 'error'").groupBy(*by).agg(F.min_by("message", "ordinal").alias("message"))
