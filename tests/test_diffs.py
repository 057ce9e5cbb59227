import difflib
import random
import re

from oracle import same_rows

from umbra.operators import findings as G
from umbra.plans import checks

RANGE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def applied(a, b, diff):
    """What the hunks make of a's lines; each hunk has to say truly where it is and what is there."""
    if not diff:
        return a
    head, rest = diff.split("\n@@ ", 1)
    assert head == "--- original\n+++ suggested"
    out, at = [], 0
    for h in ("@@ " + rest).split("\n@@ "):
        title, *body = (h if h.startswith("@@ ") else "@@ " + h).split("\n")
        # a line that ends in a line feed is followed by an empty piece
        body = [x + "\n" if y == "" else x for x, y in zip(body, [*body[1:], None], strict=True) if x]
        i, n, j, m = (int(x) if x is not None else 1 for x in RANGE.fullmatch(title).groups())
        i, j = i - (n > 0), j - (m > 0)
        out += a[at:i]
        old, new = [x[1:] for x in body if x[0] in " -"], [x[1:] for x in body if x[0] in " +"]
        assert old == a[i : i + n] and new == b[j : j + m] and len(out) == j
        out, at = out + new, i + n
    return out + a[at:]


def cases():
    r = random.Random(5)
    out = [("", "a\n"), ("a\n", ""), (None, "x"), ("x", None), (None, None), ("a\nb", "a\nb\n\n"), ("  a", "a  \n"), ("a\n", "b"), ("same\n" * 30, "same\n" * 29 + "other")]
    for n in range(60):
        a = [f"l{r.randrange(12 if n % 2 else 10**6)}\n" for _ in range(r.randrange(40))]
        b = list(a)
        for _ in range(r.randrange(1, 6)):
            k = r.randrange(len(b) + 1)
            match r.randrange(4):
                case 0:
                    b.insert(k, f"new{r.randrange(99)}\n")
                case 1:
                    del b[k : k + r.randrange(3)]
                case 2:
                    b[k : k + 1] = [f"other{r.randrange(99)}\n"]
                case _:
                    b.insert(r.randrange(len(b) + 1), b.pop(k) if k < len(b) else "end\n")
        out.append(("".join(a), "".join(b)))
    return out


def test_diffs_make_one_text_of_the_other(spark):
    texts = cases()
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, before string, after string")
    got = {r.id: r.diff for r in G.diffs(rows, "id").collect()}
    assert len(got) == len(texts)
    alike = 0
    for i, (a, b) in enumerate(texts):
        a, b = (a or "").splitlines(True), (b or "").splitlines(True)
        if "".join(a).strip() == "".join(b).strip():
            assert got[i] == ""
            continue
        assert applied(a, b, got[i]) == b, (a, b, got[i])
        want = "\n".join(difflib.unified_diff(a, b, *(s[4:] for s in G.SIDES), lineterm=""))
        alike += got[i] == want
        if len({*a}) == len(a) and len({*b}) == len(b):  # no line twice: nothing shorter is there
            changed = lambda d: sum(x[0] in "-+" for x in d.split("\n")[2:] if x)
            assert changed(got[i]) <= changed(want)
    assert alike > len(texts) // 2


def test_repeated_rows_null_keys_and_no_rows(spark):
    a, b = "".join(f"{i}\n" for i in range(20)), "".join(f"{i}\n" for i in range(20) if i not in (3, 15))
    rows = spark.createDataFrame([(1, a, b), (1, a, b), (None, a, b), (1, b, a), (2, a, b)], "a int, before string, after string")
    got = {(r.key.a, tuple(r.a) > tuple(r.b)): len(r.changes) for r in G.changes(rows, "a").collect()}
    assert G.changes(rows, "a").count() == 5 and sorted(got.values()) == [1, 2, 2, 2]
    x, y = a.splitlines(True), b.splitlines(True)
    done = [r.diff for r in G.diffs(rows, "a").collect()]
    assert len(done) == 5 and sum("\n+15" in d for d in done) == 1
    assert all(applied(y, x, d) == x if "\n+15" in d and "\n-15" not in d else applied(x, y, d) == y for d in done)
    assert G.diffs(rows.limit(0), "a").count() == 0


def test_line_ends_and_context(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\rc d\n", "a\r\nb\rC d\n")], "k int, before string, after string")
    assert G.changes(rows, "k").first().asDict(True)["changes"] == [{"i": 2, "n": 1, "j": 2, "m": 1}]
    assert G.diffs(rows, "k", context=0).first().diff == "--- original\n+++ suggested\n@@ -3 +3 @@\n-c \n+C "


def test_fixed_code(spark, sf_dir):
    same_rows(checks.autofix_diff(spark, sf_dir), checks.SQL["autofix_diff"], sf_dir)
