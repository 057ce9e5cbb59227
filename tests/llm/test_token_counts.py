import os
import random
import shutil

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from samples import ODD
from tokenizers import Tokenizer

from umbra.llm import token_counts as C

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pieces(text):
    return len(PIECES.encode(text or ""))


def key(r):
    return tuple((x is None, x or 0) for x in r)


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=key)


def want(rows, count=pieces):
    return sorted(((i, len((t or "").encode()), count(t)) for i, t, *_ in rows), key=key)


def folders(cache, name="piece_bpe_32k.model"):
    at = f"{cache}/{C.version(name)}"
    return sorted(os.listdir(at)) if os.path.isdir(at) else []


@pytest.mark.parametrize("few", [0, C.FEW])
def test_a_cache_fills_and_is_used(spark, made, tmp_path, few, monkeypatch):
    cache = str(tmp_path / "cache")
    first = [*ODD, *[(100 + i, "the same text, many times") for i in range(300)]]
    assert found(C.counted(made(first), cache, few=few)) == want(first)
    assert len(folders(cache)) == 1
    assert C.cached(spark, cache, "piece_bpe_32k.model").count() == len({t or "" for _, t in first})
    assert found(C.counted(made(first), cache, few=few)) == want(first) and len(folders(cache)) == 1  # nothing is missing
    second = [*first, (900, "a new one"), (901, "a new one"), (902, None)]
    assert found(C.counted(made(second), cache, few=few)) == want(second) and len(folders(cache)) == 2
    assert spark.read.parquet(f"{cache}/{C.version('piece_bpe_32k.model')}/{next(f for f in folders(cache) if spark.read.parquet(f'{cache}/{C.version("piece_bpe_32k.model")}/{f}').count() == 1)}").count() == 1


def test_stored_counts_are_what_a_document_gets(spark, made, tmp_path):
    cache = str(tmp_path / "cache")
    C.counted(made([(1, "planted")]), cache)
    spark.read.parquet(f"{cache}/{C.version('piece_bpe_32k.model')}/*").withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(str(tmp_path / "other" / C.version("piece_bpe_32k.model") / "x"))
    assert found(C.counted(made([(5, "planted"), (6, "not planted")]), str(tmp_path / "other"))) == [(5, 7, 77), (6, 11, pieces("not planted"))]


def test_a_batch_twice_or_in_part_does_no_harm(made, tmp_path):
    cache = str(tmp_path / "cache")
    C.counted(made(ODD), cache)
    at = f"{cache}/{C.version('piece_bpe_32k.model')}"
    shutil.copytree(f"{at}/{folders(cache)[0]}", f"{at}/again")
    assert found(C.counted(made(ODD), cache)) == want(ODD)
    for f in (f for d in folders(cache) for f in os.listdir(f"{at}/{d}")):
        if f.startswith("part-00001"):
            for d in folders(cache):
                os.path.exists(f"{at}/{d}/{f}") and os.remove(f"{at}/{d}/{f}")
    assert found(C.counted(made(ODD), cache)) == want(ODD)


def test_tokenizers_keep_apart(made, tmp_path):
    cache, rows = str(tmp_path / "cache"), [*ODD, (50, "a▁b"), (51, "a b"), (52, "x<|endoftext|>y</s>")]
    assert found(C.counted(made(rows), cache)) == want(rows)
    assert found(C.counted(made(rows), cache, "byte_bpe_50k.json")) == want(rows, lambda t: len(BYTES.encode(t or "", add_special_tokens=False)))
    assert found(C.counted(made(rows), cache)) == want(rows)
    assert C.version("piece_bpe_32k.model") != C.version("byte_bpe_50k.json") != C.version("word_bpe_49k.json")


def test_one_content_has_one_count():
    r = random.Random(1)
    assert C.escapes("piece_bpe_32k.model") and not C.escapes("byte_bpe_50k.json")
    for _ in range(3000):
        text = "".join(r.choice([" ", "▁", "a", "the", "\n", " ", "\x00", "é", "😀"]) for _ in range(r.randrange(30)))
        assert pieces(text) == pieces(text.replace("▁", " "))


def test_no_rows(none, tmp_path):
    assert C.counted(none, str(tmp_path / "cache")).count() == 0 and folders(str(tmp_path / "cache")) == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(tuple(r) for r in C.op13_token_counts(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), pieces(r.text), pieces(r.text) > 4096) for r in docs)
