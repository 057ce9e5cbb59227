"""The data source of files and archives: what it plans, reads and leaves, and its stream."""

import base64
import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra.operators import jobs as J
from umbra.sources import files as S


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(S.Files)
    return "umbra_files"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.py": b"x = 1\n", "d/b.csv": b" id,name \n1,Ann\n", "d/bad.csv": b"\xff\n", "c.PNG": b"\x89P", "bad.go": b"\xff", "none.sql": b"", "noext": b"t", "e/x.zip": zipped(src__m_dot_py="m", data_dot_csv="h1,h2\n1,2", i_dot_png=b"\x00"), "broken.zip": b"no archive", "skip/s.py": b"s"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def rows(df, root):
    return {r.path.removeprefix(f"{root}/"): (r.kind, r.body, r.language) for r in df.collect()}


WANT = {
    "a.py": ("text", "x = 1\n", "python"), "d/b.csv": ("schema", "id,name", None), "d/bad.csv": ("blocked", None, None), "c.PNG": ("binary", base64.b64encode(b"\x89P").decode(), None), "bad.go": ("blocked", None, "go"),
    "none.sql": ("schema", "", None), "noext": ("text", "t", None), "e/x.zip!/src/m.py": ("text", "m", "python"), "e/x.zip!/data.csv": ("schema", "h1,h2", None), "e/x.zip!/i.png": ("binary", base64.b64encode(b"\x00").decode(), None), "broken.zip": ("blocked", None, None),
}


def test_batch(spark, source, tree):
    for at in (tree, f"file://{tree}"):
        assert rows(spark.read.format(source).option("exclude", "skip/*").load(at), tree) == WANT
    only = spark.read.format(source).option("include", "*.py, *.csv").option("exclude", "skip/*,d/*").load(tree)
    assert set(rows(only, tree)) == {"a.py", "e/x.zip!/src/m.py", "e/x.zip!/data.csv"}
    small = spark.read.format(source).option("partitionBytes", "1").load(tree)
    assert small.rdd.getNumPartitions() >= 8 and small.count() == 12
    assert spark.read.format(source).option("include", "nothing").load(tree).count() == 0


def test_a_data_set_costs_one_line(tmp_path):
    with open(tmp_path / "big.csv", "wb") as f:
        f.write(b"id,name\n")
        f.truncate(1 << 30)  # 1 GB, of which nothing is written
    tree = S.Tree({"path": str(tmp_path)})
    assert len(tree.parts()) == 1

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += n
            return super().read(n)

    assert tree.shown("big.csv", Counted(b"id,name\n" + b"x" * 100_000)) == ("schema", "id,name") and Counted.taken <= 4096
    began = time.time()
    assert [r[1:3] for p in tree.parts() for r in tree.rows(p)] == [("schema", "id,name")]
    assert time.time() - began < 2
    endless = S.Tree({"path": str(tmp_path), "headerBytes": "10000"})
    assert len(endless.shown("x.csv", io.BytesIO(b"y" * 100_000))[1]) == 10_000


def test_members_of_an_archive_are_dealt_out(tmp_path):
    (tmp_path / "z.zip").write_bytes(zipped(**{f"m{i}_dot_py": "x" * 1000 for i in range(50)}))
    parts = S.Tree({"path": str(tmp_path), "partitionBytes": "10000"}).parts()
    assert len(parts) == 5 and sorted(m for p in parts for _, m, _ in p.items) == sorted(f"m{i}.py" for i in range(50))
    pruned = S.Tree({"path": str(tmp_path), "include": "z.zip!/m1*"}).parts()
    assert [m for p in pruned for _, m, _ in p.items] == ["m1.py", *(f"m1{i}.py" for i in range(10))]


def test_stream(spark, source, tree, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def run():
        files = spark.readStream.format(source).option("exclude", "skip/*").option("settle", "0").load(tree)
        q = files.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(f"{at}/out"), tree)

    assert run() == WANT
    with open(f"{tree}/later.py", "w") as f:
        f.write("new")
    os.utime(f"{tree}/later.py")
    time.sleep(0.1)
    assert run() == WANT | {"later.py": ("text", "new", "python")}
    assert spark.read.parquet(f"{at}/out").count() == len(WANT) + 1


def test_tamper_hash_streams(spark):
    import hashlib

    files = spark.range(3000).select((F.col("id") % 3).alias("job"), F.when(F.col("id") % 500 > 0, F.concat(F.lit("p"), F.col("id"))).alias("path"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("content"))
    want = {}
    for r in sorted(files.collect(), key=lambda r: (r.job, r.path or "", r.content or "")):
        want.setdefault(r.job, hashlib.sha256()).update((r.content or "").encode())
    assert {r.job: r.hash for r in J.tamper_hash(files, "job").collect()} == {j: h.hexdigest() for j, h in want.items()}
    odd = spark.createDataFrame([(None, "a", "x", 1), (None, "b", "y", 2), (1, None, None, 3)], "job int, path string, content string, hash int")
    assert {r.job: r.hash for r in J.tamper_hash(odd, "job").collect()} == {None: hashlib.sha256(b"xy").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}
    plan = J.tamper_hash(files, "job")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
