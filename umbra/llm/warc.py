"""WARC archives in Zstandard: a writer that stores equal payloads once, and a reader that checks what it reads.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all that follow, then has one
frame for each record. The reader decodes frame by frame and checks the version line, the required headers, the block
length, the HTTP length and both digests; what isn't right raises WarcError with the archive and the record's number.

Archives are files in the shared folder, of about ARCHIVE_BYTES of records each, renamed into place when complete, so a
task that runs again writes the same file. The dictionary of each is trained on its first payloads, SAMPLE_BYTES at
most. Payloads of REVISIT_BYTES or more that are equal are stored by the largest page_id; the others are revisits.

Defined cases: null html is an empty payload; null urls have the target `urn:none`; rows that share the largest page_id
of a payload are all responses; a null page_id is never the largest and is a revisit where another page has its payload;
an archive without records has none; very long payloads take their size in memory, one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mounted, new_folder, stored, table, tidy

#: Fixed values of the format.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

REVISIT_BYTES, ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, CHUNK = 1000, 64 << 20, 2 << 20, 16 << 10, 1 << 20


class WarcError(ValueError):
    pass


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest.hexdigest())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url else 'urn:none'}",
        f"WARC-Payload-Digest: {sha1_label(digest.digest())}",
        f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hexdigest())}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """One archive: records are held until the sample is full, then the dictionary leads the file."""

    def __init__(self, path: str) -> None:
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        self.file = open(self.part, "wb")  # noqa: SIM115
        self.held: list[bytes] = []
        self.size = self.records = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.compressor:
            self.file.write(self.compressor.compress(record))
            return
        self.held.append(record)
        if self.size >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        sample, room = [], SAMPLE_BYTES
        for r in self.held:
            if len(r) <= room:
                sample.append(r)
                room -= len(r)
        try:
            of = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # too few or too short to learn from: an archive without dictionary
            of = None
        if of is not None:
            data = of.as_bytes()
            self.file.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=of, write_checksum=True) if of else zstandard.ZstdCompressor(level=3, write_checksum=True)
        for r in self.held:
            self.file.write(self.compressor.compress(r))
        self.held = []

    def close(self) -> None:
        if not self.compressor:
            self.begin()
        self.file.close()
        os.replace(self.part, self.path)


def frames(file: BinaryIO, name: str) -> Iterator[bytes]:
    """The content of each frame, one at a time; the dictionary comes from a leading skippable frame."""
    rest, dictionary, first = b"", None, True
    while True:
        while len(rest) < 8 and (more := file.read(CHUNK)):
            rest += more
        if not rest:
            return
        if len(rest) >= 8 and (magic := struct.unpack("<I", rest[:4])[0]) in SKIPPABLE:
            n = struct.unpack("<I", rest[4:8])[0]
            while len(rest) < 8 + n and (more := file.read(CHUNK)):
                rest += more
            if len(rest) < 8 + n:
                raise WarcError(f"{name}: a skippable frame is cut off")
            body, rest = rest[8 : 8 + n], rest[8 + n :]
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise WarcError(f"{name}: the dictionary doesn't lead")
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(body) if body[:4] == FRAME_MAGIC else body)
            first = False
            continue
        first = False
        decoder = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        try:
            out.append(decoder.decompress(rest))
            while not decoder.eof:
                if not (more := file.read(CHUNK)):
                    raise WarcError(f"{name}: a frame is cut off")
                out.append(decoder.decompress(more))
        except zstandard.ZstdError as e:
            raise WarcError(f"{name}: {e}") from e
        rest = decoder.unused_data
        yield b"".join(out)


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"no header: {line[:60]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> Record:
    """One record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise WarcError(f"version line {version[:20]!r}")
    headers = _headers(lines)
    if missing := [h for h in REQUIRED if h not in headers]:
        raise WarcError(f"without {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{len(rest) - 4} bytes in a block of {headers['content-length']}")
    block = rest[:-4]
    if (d := headers.get("warc-block-digest")) and d != sha1_label(hashlib.sha1(block).digest()):
        raise WarcError("block digest")
    http, payload = {}, block
    if headers.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = head.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise WarcError(f"status line {status[:20]!r}")
        http = _headers(lines)
    if headers["warc-type"] == "response":
        if "content-length" in http and int(http["content-length"]) != len(payload):
            raise WarcError("HTTP length")
        if (d := headers.get("warc-payload-digest")) and d != sha1_label(hashlib.sha1(payload).digest()):
            raise WarcError("payload digest")
    elif headers["warc-type"] == "revisit" and ("warc-refers-to" not in headers or payload):
        raise WarcError("a revisit with a payload or without what it refers to")
    return Record(headers, http, payload)


def read_archive(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        for k, data in enumerate(frames(f, path)):
            try:
                yield parse(data)
            except (WarcError, ValueError) as e:
                raise WarcError(f"{path}, record {k}: {e}") from e


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: ''), refers_to: the page whose response a revisit names, null for responses."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    large = F.octet_length("html") >= REVISIT_BYTES
    keyed = rows.withColumn("key", F.when(large, F.sha1(payload)).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))))
    first = rows.where(large).groupBy(F.sha1(payload).alias("key")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n")
    joined = keyed.join(first, "key", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns archive, records; one row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, k, writer, done = TaskContext.get().partitionId(), 0, None, []
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for page_id, url, html, refers_to in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                if writer is None:
                    writer, k = Writer(f"{folder}/pages-{task:06d}-{k:06d}.warc.zst"), k + 1
                page = None if pd.isna(page_id) else int(page_id)
                revisit = not pd.isna(refers_to)
                writer.add(record_bytes(page, url, html.encode("utf-8", "replace"), int(refers_to) if revisit else None, revisit))
                if writer.size >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((writer.path, writer.records))
                    writer = None
        if writer:
            writer.close()
            done.append((writer.path, writer.records))
        if done:
            yield pd.DataFrame(done, columns=["archive", "records"])

    return stored(planned(pages).mapInPandas(tidy(run), "archive string, records long"), "archives")


SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives (column archive, paths that workers can open)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * with_payload
        held = 0

        def frame() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
            out.clear()
            return done

        for b in batches:
            for path in b["archive"]:
                for r in read_archive(path):
                    h = r.headers
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in h else hashlib.sha1(r.payload).hexdigest()
                    size = len(r.payload) if h["warc-type"] != "revisit" else int(r.http["content-length"]) if "content-length" in r.http else None
                    row = (int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"), h["warc-type"], size, digest, int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None)
                    out.append((*row, r.payload) if with_payload else row)
                    held += len(r.payload) * with_payload + 200
                    if held > 16 << 20:
                        yield frame()
                        held = 0
        if out:
            yield frame()

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInPandas(tidy(run), SCHEMA + ", payload binary" * with_payload)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = mounted(new_folder(spark, "warc"))
    return read(write(table(spark, sf_dir, "pages"), folder), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d
"""
