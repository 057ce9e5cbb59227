import io
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra.operators import answers as N
from umbra.operators import findings as G
from umbra.operators import jobs as J
from umbra.operators import protection as P
from umbra.operators.locks import lock_facts, on_cycles
from umbra.sources import readers as S
from umbra.streaming.jobs import appended_lines


def test_source_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "d/b.js": b"let y", "c.txt": b"no", "bad.go": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.language, r.content) for r in S.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "x = 1"), "d/b.js": ("javascript", "let y"), "bad.go": ("go", "# ERROR: failed to read file: not UTF-8\n")}


def test_unzipped(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/b.py", "x")
    rows = spark.createDataFrame([("z", bytearray(data.getvalue())), ("broken", bytearray(b"no"))], "path string, content binary")
    assert [tuple(r) for r in S.unzipped(rows).collect()] == [("z", "a/b.py", "x")]


def test_shown(spark):
    rows = spark.createDataFrame([("a.png", bytearray(b"\x89")), ("b.csv", bytearray(b"id,name\n1,Ann")), ("c.csv", bytearray(b"\xff")), ("d.py", bytearray(b"x"))], "path string, content binary")
    got = {r.path: (r.s.kind, r.s.body) for r in rows.select("path", S.shown(F.col("path"), F.col("content")).alias("s")).collect()}
    assert got == {"a.png": ("binary", "iQ=="), "b.csv": ("schema", "id,name"), "c.csv": ("blocked", None), "d.py": ("text", "x")}


def test_audit(spark, tmp_path):
    lines = spark.createDataFrame([("[2024-01-02T03:04:05.000006] READ | a.py | 2",), ("noise",)], "value string")
    S.append_audit(lines, f"{tmp_path}/log")
    for _ in range(2):  # the second one replaces the first
        S.append_audit(lines, f"{tmp_path}/log", "job-7")
    got = S.audit_lines(S.audit_log(spark, f"{tmp_path}/log")).collect()
    with pytest.raises(ValueError, match="name of a batch"):
        S.append_audit(lines, f"{tmp_path}/log", "../x")
    assert len(got) == 2 and got[0].action == "READ" and got[0].details == "a.py | 2"


def test_truncated_bytes(spark):
    rows = spark.createDataFrame([("é" * 10,), ("ab",), (None,)], "t string")
    assert [r.t for r in rows.select(G.truncated_bytes(F.col("t"), 5).alias("t")).collect()] == ["éé\ufffd\n...[truncated]", "ab", None]


def test_capped(spark):
    rows = spark.createDataFrame([("p", i, "t", "m" + str(i % 1500), "f", 1, 1) for i in range(3000)], "path string, ordinal long, tool string, message string, file string, line int, column int")
    out = G.capped(rows)
    assert out.count() == 1000 and out.agg(F.max("ordinal")).first()[0] == 999


ANSWERS = [
    ('{"code": "x"}', {"<file>": "x\n"}),
    ('{"code": 5}', {"<file>": '{"code": 5}\n'}),  # no string, but a brace
    ('{"files": {" a.py ": "1", "b.py": "2\\n"}}', {"a.py": "1\n", "b.py": "2\n"}),
    ('{"files": {}}', {}),
    ('so: [1] and {"files": {"a.py": "1"}}', {"<file>": 'so: [1] and {"files": {"a.py": "1"}}\n'}),  # a list comes first
    ('so:\n```json\n{"files": {"a.py": "1"}}\n```', {"a.py": "1\n"}),
    ('so {"files": {"a.py": "{"}} or', {"a.py": "{\n"}),
    ("**File: a.py**\n```py\n1\n```\n**File: a.py**\n```\n2\n```", {"a.py": "2\n"}),
    ("**File: a.py**\n```py\n1\n```\ntext\n**File: d/b.js**\n\n```\n2\n\n3\n```", {"a.py": "1\n", "d/b.js": "2\n\n3\n"}),
    ("File: a.py\n```\n1\n```\nFile: a.py\n```\n2\n```", {"a.py": "1\n"}),
    ("see src/x.go here\n```go\nf\n```\n" + "z" * 250 + "\n```\ng\n```", {"src/x.go": "f\n", "<file_1>": "g\n"}),
    ("file:  q.md \nand\n```\nf\n```", {"q.md": "f\n"}),
    ("```\n\n```", {"<file_0>": "\n"}),
    ("import os\r\nx", {"<file>": "import os\nx\n"}),
    ("nothing here", {}),
    (" \n", {}),
    (None, {}),
    ("{broken", {"<file>": "{broken\n"}),
]


def test_parsed_files(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").select("i", N.parsed_files(F.col("a")).alias("f"))
    got = {r.i: r.f for r in rows.collect()}
    wrong = {ANSWERS[i][0]: (got[i], want) for i, (_, want) in enumerate(ANSWERS) if got[i] != want}
    assert not wrong
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_found_json(spark):
    cases = [('so: {"a": [1, 2]} and {b}', '{"a": [1, 2]}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ("{broken", None), ("[1, {2]", "[1, {2]"), ("x } { y", None), (" 7 ", " 7 "), ("null", None), (None, None), ("", None)]
    got = [r.j for r in spark.createDataFrame(cases, "t string, w string").select(N.found_json(F.col("t")).alias("j")).collect()]
    assert got == [w if t != "[1, {2]" else None for t, w in cases]


def test_first_errors(spark):
    rows = spark.createDataFrame([("p", 3, "error", "b"), ("p", 2, "warning", "w"), ("p", 4, "error", "a"), ("q", 1, "info", "i")], "path string, ordinal long, severity string, message string")
    assert [tuple(r) for r in N.first_errors(rows, "path").collect()] == [("p", "b")]


def test_lock_facts():
    got = lock_facts("A = Lock()\ndef f():\n    with A, B:\n        C.acquire()")
    assert [x[:1] + x[4:] for x in got] == [("def", "A"), ("acquire", "A"), ("acquire", "B"), ("acquire", "C"), ("with", "A"), ("with", "B")]
    twice = lock_facts("def f():\n    with x.acquire(), y.timed(1):\n        pass\ndef f():\n    def g():\n        z.acquire()\nq.acquire()")
    assert [(k, fn, n, lock) for k, fn, n, _, lock in twice] == [("acquire", "f", 0, "x"), ("acquire", "f", 0, "y"), ("acquire", "f", 0, "x"), ("with", "f", 1, "x"), ("with", "f", 1, "y"), ("acquire", "f", 1, "z"), ("acquire", "g", 0, "z")]
    assert lock_facts("def (") == [] == lock_facts(None)


def test_long_ways(spark):
    """A ring and a chain of hundreds of locks."""
    edges = [(f"r{i}", f"r{(i + 1) % 300}") for i in range(300)] + [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("r0", "c0"), ("s", "s"), (None, "x")]
    got = {r.node for r in on_cycles(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"r{i}" for i in range(300)} | {"s"}
    assert on_cycles(spark.createDataFrame([], "a string, b string")).count() == 0


def test_validated_path(spark, tmp_path):
    reports, whole = G.validated_path(spark, str(tmp_path / "nowhere"))
    assert reports is None and whole.first().error.startswith("Path not found: ")
    (tmp_path / "a.py").write_text("try:\n    eval(x)\nexcept:\n    pass\n")
    (tmp_path / "b.py").write_text("def f(:")
    (tmp_path / "c.js").write_text("let x")
    reports, whole = G.validated_path(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/")[-1], r.status, r.errors, r.warnings) for r in reports.collect()) == [("a.py", "error", 1, 1), ("b.py", "error", 1, 0), ("c.js", "ok", 0, 0)]
    assert whole.first().asDict() == {"errors": 2, "warnings": 1, "info": 0, "files_validated": 3, "note": None, "error": None}
    nothing = G.validated_path(spark, str(tmp_path), ["*.go"])[1].first()
    assert nothing.files_validated == 0 and nothing.note == "No discoverable files."


def test_validated_code(spark):
    r = G.validated_code(spark, "x = eval('1')", "a.py").first()
    assert (r.status, r.language, r.findings[0].id) == ("error", "python", "ast:insecure-eval")
    assert G.validated_code(spark, "popen it").first().findings[0].tool == "heuristic"
    assert G.validated_code(spark, None).first().status == "ok"


def test_tests_of_languages(spark):
    rows = spark.createDataFrame([("rust",), ("Typescript",), (None,), ("cobol",)], "l string").select(P.placeholder_test(F.col("l")).alias("t"), P.test_command(F.col("l")).alias("c")).collect()
    assert [r.t.file for r in rows] == ["tests.rs", "test_code.js", "test_code.py", "test_placeholder.txt"]
    assert rows[2].c.startswith("pytest -q .") and rows[3].c.endswith("exit 2") and all(r.t.content for r in rows)


def test_written_back(spark, tmp_path):
    corpus = spark.createDataFrame([("a.js", "let total = 5"), ("b.py", "def (")], "path string, content string")
    safe = P.protect(corpus, salt="s")
    P.saved(safe.select("path", "safe"), safe, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.js", "let total = 5")]
    assert str(safe._jdf.queryExecution().optimizedPlan()).count("LogicalRDD") == 1  # the corpus is read once


def test_streams_to_sinks(spark, tmp_path):
    spark.createDataFrame([("[2024-01-02T03:04:05.000006] READ | a.py",)], "value string").write.text(str(tmp_path / "in"))
    appended_lines(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state"))
    assert [r.action for r in S.audit_lines(S.audit_log(spark, str(tmp_path / "log"))).collect()] == ["READ"]
    job = spark.createDataFrame([("j", "u", None, "fix", "auto", "2024-01-02")], "job_id string, user_id string, ip_address string, task string, provider string, created_at string")
    for _ in range(2):
        J.inserted(J.new_jobs(job), str(tmp_path / "jobs"))
    assert [r.status for r in spark.read.parquet(str(tmp_path / "jobs")).collect()] == ["pending", "pending"]


def test_internal(spark):
    r = spark.range(1).select(G.internal("mypy", F.lit("gone")).alias("f")).first().f
    assert r.id == "internal:mypy" and r.severity == "error" and r.file is None and r.line is None


def test_validated_with_reports(spark):
    """Reports of any tool join what the checks say; each finding once, the checks' own first."""
    files = spark.createDataFrame([("a.js", "let x = 1"), ("b.py", "eval('1')"), ("c.py", "x = 1"), ("d.py", None)], "path string, content string")
    eslint = '[{"filePath": "a.js", "messages": [{"ruleId": "semi", "severity": 2, "message": "m", "line": 1, "column": 2}, {"severity": 1, "message": "n"}]}]'
    bandit = '{"results": [{"filename": "b.py", "line_number": 1, "issue_severity": "LOW", "test_id": "B1", "issue_text": "t"}]}'
    reports = spark.createDataFrame([("a.js", "eslint", eslint), ("b.py", "bandit", bandit), ("b.py", "flake8", "b.py:1:1: E501 long\nb.py:1:1: E501 long"), ("c.py", "bandit", "{"), ("c.py", None, None), ("gone.py", "flake8", "g.py:1:1: E1 x")], "path string, tool string, stdout string")
    rows = {r.path: r for r in G.validated(files, reports).collect()}
    assert {p: (r.errors, r.warnings, r.info, r.status, [f.id for f in r.findings]) for p, r in rows.items()} == {
        "a.js": (1, 1, 0, "error", ["eslint:semi", "eslint:unknown"]),
        "b.py": (2, 0, 1, "error", ["ast:insecure-eval", "bandit:B1", "flake8:E501"]),
        "c.py": (0, 0, 0, "ok", []),
        "d.py": (0, 0, 0, "ok", []),
    }


def test_spread(spark, tmp_path):
    """A row group is one task's, however many splits its file has; many files stay as they are."""
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
        one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
        assert one.rdd.getNumPartitions() > cores
        rows = S.spread(one).rdd.glom().map(len).collect()
        assert len(rows) == cores and min(rows) > 0
        assert "Exchange" not in S.spread(many)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
