import hashlib
import os
import struct

import pytest
import zstandard
from oracle import same_rows

from umbra.llm import warc as W


def test_against_sql(spark, sf_dir):
    same_rows(W.op6_warc(spark, sf_dir), W.OP6_SQL, sf_dir)


PAGES = [(1, "http://a/\r\nb é", "x" * 1000), (9, "u", "x" * 1000), (9, "u", "x" * 1000), (3, None, None), (4, "u", "x" * 999), (5, "u", "x" * 999), (None, "u", "x" * 1000), (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "y" * 3_000_000)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, key int").coalesce(2)
    rows = W.read(W.write(pages, f"{tmp_path}/w")).collect()
    assert len(rows) == len(PAGES)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = sorted((str(i), "revisit" if to else "response", size(t), sha(t), to) for (i, _, t), to in zip(PAGES, [9, None, None, None, None, None, 9, 8, None, None], strict=True))
    assert got == want
    assert {bytes(r.payload) for r in rows if r.page_id == 10} == {b"y" * 3_000_000}
    assert W.read(W.write(pages.limit(0), f"{tmp_path}/none")).count() == 0


def test_archive_form(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>page {i} " + "common words of all pages " * 30) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    path = W.write(pages, f"{tmp_path}/w").first().archive
    data = open(path, "rb").read()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == W.DICTIONARY_MAGIC
    frames = data[8 + n :]
    assert frames.count(W.FRAME_MAGIC) >= 200
    assert sum(1 for _ in W.read_archive(path)) == 200
    # the dictionary itself may be compressed
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + n])
    other = f"{tmp_path}/other.warc.zst"
    with open(other, "wb") as f:
        f.write(struct.pack("<II", magic, len(packed)) + packed + frames)
    assert sum(1 for _ in W.read_archive(other)) == 200
    for name, bad in {"cut": data[:-3], "dictionary": data[: 8 + n // 2], "none": frames}.items():
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(bad)
        with pytest.raises(W.WarcError):
            list(W.read_archive(f"{tmp_path}/{name}"))


def test_faults_are_found():
    good = W.record_bytes(1, "u", b"payload", None, False)
    assert W.parse(good).payload == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good[:-4], good + b"x", good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(W.WarcError):
            W.parse(bad)


def test_empty_file(tmp_path):
    open(f"{tmp_path}/e", "wb").close()
    assert list(W.read_archive(f"{tmp_path}/e")) == [] and os.path.getsize(f"{tmp_path}/e") == 0
