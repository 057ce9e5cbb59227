import zlib

import numpy as np
import public_tokenizers
from samples import ODD
from tokenizers import Tokenizer

from umbra.llm import packing as P

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs):
    left = {}
    for r in rows:
        left.setdefault(r.sequence_id, []).append(r)
    for pieces in left.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.CAPACITY
    whole = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
        whole.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for doc_id, text in docs:
        want = [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(whole[doc_id])
        assert [i for _, ids, _ in got for i in ids] == want and all(n == len(want) for *_, n in got)
    return sum(P.CAPACITY - n for n in (sum(r.length for r in p) for p in left.values()) if n & (n - 1)) / max(1, sum(r.length for r in rows))


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    padding = check(P.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 0.05  # a few windows of four small tasks


def test_odd_rows(odd, none):
    rows = P.pack(odd).collect()
    check([r for r in rows if r.doc_id != 5], [r for r in ODD if r[0] != 5])
    assert len({r.sequence_id for r in rows}) > 1 and sum(r.length for r in rows if r.doc_id == 5) == 2 * [r.doc_tokens for r in rows if r.doc_id == 5][0]
    assert P.pack(none).count() == 0


def test_special_token_string(made):
    text = "a<|endoftext|>b"
    got = [i for r in P.pack(made([(1, text)])).collect() for i in r.ids]
    assert got == [*WHOLE.encode(text, add_special_tokens=False).ids, 1]


def test_differencing():
    r = np.random.default_rng(0)
    for n, ways in ((40, 5), (7, 10), (300, 64), (1, 1)):
        sizes = r.integers(1, 512, n).tolist()
        got = P.partition(sizes, ways)
        assert sorted(i for g in got for i in g) == list(range(n)) and len(got) <= ways
        sums = [sum(sizes[i] for i in g) for g in got]
        if n > 4 * ways:
            assert max(sums) - min(sums) < 0.06 * max(sums)
    assert P.partition([8, 7, 6, 5, 4], 2) and {sum([8, 7, 6, 5, 4][i] for i in g) for g in P.partition([8, 7, 6, 5, 4], 2)} == {16, 14}


def test_window_count_rises():
    sizes = [1500] * 4
    got = P.windows_of(sizes, 2048)
    assert len(got) == 4 and all(sum(sizes[i] for i in g) <= 2048 for g in got)
    assert P.windows_of([], 2048) == []
