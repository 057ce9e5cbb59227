"""One very long text through the operators that read whole texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import stories

from umbra.llm import language_model as L
from umbra.llm import mixing, near_copies, packing, simhash, toxicity

WORDS = 800_000


@pytest.fixture(scope="module")
def long(made):
    """Five million characters, nearly the same again, and a short text."""
    t = stories(1, WORDS, 81, 3000)[0]
    return made([(1, t), (2, t + " and an end"), (3, "short text of six words here")])


def test_near_copies_of_long_texts(long):
    assert sorted(r.doc_id for r in near_copies.without_near_copies(long).select("doc_id").collect()) == [1, 3]


def test_simhash_of_long_texts(long):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(long).collect()}
    assert (got[1] ^ got[2]).bit_count() <= 2 and got[1] != got[3]


def test_mixing_and_packing_long_texts(long):
    assert {r.doc_id: r.size for r in mixing.sized(long).collect()} == {1: WORDS, 2: WORDS + 3, 3: 6}
    rows = packing.pack(long.where("doc_id != 2")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d"), F.max("length").alias("m")).collect()
    assert all(r.n == r.d and r.m <= 2048 for r in rows) and max(r.n for r in rows) > WORDS


def test_toxicity_of_long_texts():
    text = " ".join(["plain"] * WORDS + ["idiot"])
    x = toxicity.features([text, "plain"], toxicity.Memo({"=idiot": 4.0}))
    assert x[0, 0] == 1 / (WORDS + 1) and np.isfinite(x).all()


def test_model_of_long_texts(long):
    model = L.train(long.select("doc_id", "text"))
    got = {r.doc_id: r for r in L.scored(long.select("doc_id", "text"), model).collect()}
    assert got[1].n_tokens == WORDS + 1 and got[1].n_known == got[1].n_tokens and np.isfinite(got[1].score)
