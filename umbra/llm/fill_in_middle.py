"""Fill-in-the-middle documents: prefix, middle and suffix cut between tokens, told apart by <P>, <S> and <M>.

A batch of texts is worked on as Arrow holds it: one array of UTF-8 bytes and the offsets of the documents. A table of
256 classes says which bytes are white space; a token ends at a byte that isn't, before one that is, and at a document's
last byte. The running number of such ends, less what it was at a document's start, numbers its tokens, and one search
for the wanted numbers gives the cuts of all documents at once. Only ASCII bytes decide, so no cut parts a character.
What is cut off depends on the id alone (four numbers of a SHA-256), so reruns agree.

Defined cases: a null text is an empty one, which is plain; a null id counts as an empty string in the hash; white space
alone is one token; a text that holds a sentinel stays plain, so that every other output can be taken apart again; equal
rows have equal outputs; a very long text is cut on its whole length, and is the only large one in its batch; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: White space of ASCII.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FORMS = np.array(["plain", "psm", "spm"], dtype=object)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins (and the last one ends) in them."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def counted(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each place, and after the last one; as narrow as it can be."""
    out = np.zeros(len(marks) + 1, dtype=np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a token ends with the byte."""
    space = SPACE[data]
    ends = np.zeros(len(data), dtype=bool)
    ends[:-1] = ~space[:-1] & space[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]]
    ends[last - 1] = True
    return ends


def with_sentinel(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a document holds a sentinel."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    at = np.flatnonzero(data[:-2] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [ord(c) for c in SENTINELS])]
    of = np.searchsorted(offsets, at, side="right") - 1
    out[of[at + 2 < offsets[of + 1]]] = True  # the whole of it lies in one document
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's tokens, and the bytes at which its prefix and its middle end; h: two numbers a document."""
    before = counted(token_ends(data, offsets))
    base = before[offsets[:-1]].astype(np.int64)
    n = before[offsets[1:]] - base
    k = np.sort(h % (n + 1)[:, None], axis=1)
    # the first place before which so many tokens of the document have ended; no token: its start
    places = np.searchsorted(before, base[:, None] + k, side="left")
    return n, *np.where(k > 0, places, offsets[:-1, None]).T


def _kernel(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column("text"))
            h = np.stack([batch.column(f"h{i}").to_numpy() for i in range(1, 5)], axis=1)
            n, first, second = cuts(data, offsets, h[:, :2])
            plain = (n == 0) | (h[:, 2] % 100 >= rate) | with_sentinel(data, offsets)
            form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
            characters = counted((data & 0xC0) != 0x80)
            raw, parts, ends = memoryview(data), [], []
            p, s, m = SENTINELS.values()
            at = 0
            for kind, a, x, y, z in zip(form.tolist(), offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), strict=True):
                parts += [raw[a:z]] if kind == 0 else [p, raw[a:x], s, raw[y:z], m, raw[x:y]] if kind == 1 else [s, raw[y:z], p, raw[a:x], m, raw[x:y]]
                at += z - a + 9 * (kind > 0)
                ends.append(at)
            wide = at >= 1 << 31
            out = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(ends), pa.py_buffer(np.array([0, *ends], dtype=np.int64 if wide else np.int32)), pa.py_buffer(b"".join(parts)))
            length = lambda a, z: pa.array(characters[z].astype(np.int64) - characters[a], mask=plain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), length(offsets[:-1], first), length(first, second), out], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output; rate: of 100 documents so many are cut, and of these spm so many in the form spm."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *numbers)
    return rows.mapInArrow(tidy(_kernel(rate, spm)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output of that form was made of."""
    parts = F.array(F.split(output, "<[PSM]>", -1))  # nothing, then the three in the form's order; of a lambda's argument each is taken without a second split
    psm = F.transform(parts, lambda x: F.concat(x[1], x[3], x[2]))[0]
    spm = F.transform(parts, lambda x: F.concat(x[2], x[3], x[1]))[0]
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("form"), F.col("output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
k AS (
  SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS y,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(t[greatest(x, y) + 1:], '') AS s FROM k),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
