import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import ODD

from umbra.llm import fill_in_middle as M

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (doc_id, len(tokens), "plain", None, None, text)
    spm_ = h[3] % 100 < spm
    return (doc_id, len(tokens), "spm" if spm_ else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_ else f"<P>{p}<S>{s}<M>{m}")


def key(r):
    return (r[0] is None, r[0] or 0)


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 50), (0, 0)])
def test_as_by_the_rule(made, rate, spm):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "é", "😀", " ", " ", " ", "\t", "\n", "\x0b", "<", "P", "<P>x", ">", "<S", "M>", "word"]) for _ in range(r.randrange(60))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = sorted((tuple(x) for x in M.fill_in_middle(made(rows), rate=rate, spm=spm).collect()), key=key)
    assert got == [plainly(i, t, rate=rate, spm=spm) for i, t in rows]


def test_odd_rows(odd, none):
    got = sorted((tuple(x) for x in M.fill_in_middle(odd, rate=100).collect()), key=key)
    assert got == sorted((plainly(i, t, rate=100) for i, t in ODD), key=key)
    assert M.fill_in_middle(none).count() == 0


def test_restored(made):
    rows = [(i, t) for i, t in enumerate([" a<S", "<<P", "<P", "P>", "x <", "a b c d e\n", "<S<M", None, "é 😀 ü " * 30] * 20)]
    docs = made(rows)
    back = M.fill_in_middle(docs, rate=100).select("doc_id", "form", M.restored(F.col("form"), F.col("output")).alias("back"))
    got = {r.doc_id: (r.form, r.back) for r in back.collect()}
    assert {i: b for i, (_, b) in got.items()} == {i: t or "" for i, t in rows} and {f for f, _ in got.values()} == {"plain", "psm", "spm"}


def test_a_sentinel_over_two_documents_is_none():
    for parts in (["<", "P>"], ["a<P", ">"], ["<P>", ""], ["", "x<M>"], ["<S", ""]):
        data, offsets = M.utf8(pa.array(["x", *parts]).slice(1))
        assert M.with_sentinel(data, offsets).tolist() == [bool(re.search("<[PSM]>", p)) for p in parts]
        assert M.cuts(data, offsets, np.array([[9, 7]] * 2))[0].tolist() == [len(TOKEN.findall(p)) for p in parts]


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in M.op12_fill_in_middle(spark, sf_dir).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        *rest, out = plainly(r.doc_id, r.text)
        assert tuple(got[r.doc_id]) == (*rest, sha(out), sha(r.text or ""))
