"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents are tokenised, ended by id 1 and cut at the capacity; what is left of each is cut into pieces of at most
`piece` ids. A group of pieces that would fill about `windows` windows is partitioned: partial partitions, each a list
of window sums, are merged largest spread first, the fullest window of one with the emptiest of the other, so that
their imbalances cancel. If a window then exceeds the capacity, the group is partitioned again into one window more.
A task packs its own documents, so nothing is shuffled and memory holds one group.

Defined cases: a null or empty text is the end id alone; null ids are kept; very long texts are many full windows and
one rest; equal rows are packed each for itself; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, tidy

CAPACITY, END, PIECE, WINDOWS, FLUSH = 2048, 1, 256, 128, 1 << 17


def partition(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of sizes in `ways` groups of near-equal sums (multiway differencing)."""
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]  # spread, order, the windows that hold anything, fullest first
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = ways - len(a)
        if len(b) <= spare:
            both = a + b
        else:  # the fullest of b join the emptiest of a
            over = len(b) - spare
            both = a[: len(a) - over] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[:over]), strict=True)] + b[over:]
            if spare and over:
                rest = sorted(a + [(0, None)] * spare, key=lambda x: -x[0])
                full = b + [(0, None)] * (ways - len(b))
                both = [(x[0] + y[0], x[1] if y[1] is None else y[1] if x[1] is None else (x[1], y[1])) for x, y in zip(rest, reversed(full), strict=True)]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0] if len(both) == ways else 0
        heapq.heappush(heap, (low - both[0][0], at, both))
    out = []
    for _, tree in heap[0][2] if heap else []:
        found, todo = [], [tree]
        while todo:
            x = todo.pop()
            todo.extend(x) if isinstance(x, tuple) else found.append(x)
        out.append(sorted(found))
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of sizes, each at most the capacity; one more group whenever one is above."""
    ways = -(-sum(sizes) // capacity)
    while ways:
        found = partition(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        ways += 1
    return []


def tokenizer(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them for a byte-level BPE file.

    The file's own ranks and the same split pattern run in tiktoken, several times as fast with equal ids; a text that
    holds a special token's string goes through the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    del spec, ranks
    release()
    whole = []  # read when first needed

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special):
            return fast.encode_ordinary(text)
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(path))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packer(path: str | None, capacity: int, end: int, piece: int, windows: int, with_ids: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

        encode = tokenizer(path or public_tokenizers.path("byte_bpe_50k.json"))
        # a window's number: the task's partition, then a count
        number = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        open_: list[tuple] = []  # doc_id, document's number, ids, start, tokens
        held = waiting = 0

        def put(pieces: list[tuple]) -> None:
            nonlocal number, waiting
            at = 0
            for doc_id, _, ids, start, total in pieces:
                row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at)
                out.append((*row, ids.astype(np.int32)) if with_ids else row)
                at += len(ids)
                waiting += len(ids) * with_ids
            number += 1

        def close() -> None:
            nonlocal held
            for window in windows_of([len(x[2]) for x in open_], capacity):
                joined: list[tuple] = []
                for x in sorted((open_[i] for i in window), key=lambda x: (x[1], x[3])):
                    if joined and joined[-1][1] == x[1] and joined[-1][3] + len(joined[-1][2]) == x[3]:
                        joined[-1] = (*x[:2], np.concatenate([joined[-1][2], x[2]]), joined[-1][3], x[4])
                    else:
                        joined.append(x)
                put(joined)
            open_.clear()
            held = 0

        def frame() -> pd.DataFrame:
            names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
            nonlocal waiting
            done = pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
            out.clear()
            waiting = 0
            return done

        k = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.asarray([*encode(text or ""), end], dtype="<u4")
                k += 1
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    put([(doc_id, k, ids[start : start + capacity], start, len(ids))])
                for start in range(full, len(ids), piece):
                    open_.append((doc_id, k, ids[start : start + piece], start, len(ids)))
                held += len(ids) - full
                if held >= windows * capacity:
                    close()
                if len(out) >= 20_000 or waiting >= FLUSH:
                    yield frame()
        close()
        if out:
            yield frame()

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, piece: int = PIECE, windows: int = WINDOWS, with_ids: bool = True) -> DataFrame:
    """One row for each piece, with its token ids if with_ids; path: the tokenizer file (None: the public byte-level one)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(tidy(packer(path, capacity, end, piece, windows, with_ids)), SCHEMA + ", ids array<int>" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
