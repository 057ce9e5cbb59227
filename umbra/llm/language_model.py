"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped sorted hash arrays.

Tokens are the words of a text, A-Z lower-cased, then one end. Words are known by their 64-bit hash. Three passes:
word counts; word pairs, merged by shards of the context's hash (a context with more tokens than a shard is meant to hold
is spread by both hashes: there are at most as many as shards); and the contexts and continuations that the merged pairs
give. Shards hold half a million tokens each, more where there would be over MOST_SHARDS of them. The model is a folder of .npy arrays sorted by hash: pair shards (key, count) and word shards (key,
count, context total, back-off mass, continuation probability). Scoring maps them into memory and looks up the distinct
pairs of each block of texts. All counts cover all training texts, and grow with them.

p(w | u) = max(c(u, w) - D, 0) / c(u) + mass(u) * p1(w), with D of three levels by count; p1 is the same over
continuation counts, its mass spread evenly over the V known types and one for all unknown words. A context never seen
backs off wholly to p1. Each conditional distribution sums to one.

Defined cases: null and empty texts are the end alone; equal rows count each; a null id is hashed as an empty text; an
empty training set leaves one uniform unknown type; an empty table has no scores; a very long text is one block by itself
(some 16 bytes a token); two words, or pairs, of one 64-bit hash count as one (a chance of n^2 / 2^65 for n of them: one
in four thousand among a hundred million); other columns don't matter. Counts are kept as wide as the greatest needs.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, mounted, new_folder, stored, table, tidy, words

START, END = b" <s>", b" </s>"  # the space keeps them apart from any word
BLOCK_TOKENS, TOKENS_PER_SHARD, LEAST_SHARDS, MOST_SHARDS, OPEN, BLOB_BYTES = 1 << 21, 1 << 19, 16, 1 << 18, 4096, 4 << 20


class Model(NamedTuple):
    folder: str
    pair_shards: int
    word_shards: int
    hot: tuple[int, ...]
    discounts: tuple[float, float, float]
    unknown: float
    tokens: int
    types: int
    lengths: dict[tuple[str, int], int]  # entries of each shard that was written, by kind and number


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B185EBCA87) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(29))


def _shard(u: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return np.where(np.isin(u, hot), pair_key(u, w), u) % np.uint64(shards)


class _Ids(dict):
    """word -> number in order of first sight; 0 is START, 1 END."""

    def __init__(self) -> None:
        super().__init__({START: 0, END: 1})

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self), dtype=np.uint64, count=len(self))


def _blocks(batches: Iterator[pd.DataFrame], carried: list[str]) -> Iterator[tuple[_Ids, np.ndarray, np.ndarray, list]]:
    """Blocks of texts: their words, the tokens of all texts (START first, END last in each), lengths, carried columns."""
    ids, parts, lengths, rows, n = _Ids(), [], [], [], 0
    for b in batches:
        for text, *row in zip(b["text"], *[b[c] for c in carried], strict=True):
            w = words(text)
            t = np.empty(len(w) + 2, dtype=np.int64)
            t[0], t[-1] = 0, 1
            t[1:-1] = [ids[x] for x in w]
            parts.append(t)
            lengths.append(len(t))
            rows.append(row)
            n += len(t)
            if n >= BLOCK_TOKENS:
                yield ids, np.concatenate(parts), np.array(lengths), rows
                ids, parts, lengths, rows, n = _Ids(), [], [], [], 0
    if parts:
        yield ids, np.concatenate(parts), np.array(lengths), rows


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), *more)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for ids, tokens, lengths, _ in _blocks(batches, []):
        c = np.bincount(tokens, minlength=len(ids))
        c[0] = 0
        seen = c > 0
        yield pd.DataFrame({"w": ids.hashes()[seen].view(np.int64), "c": c[seen]})


def _pair_blobs(hot: np.ndarray, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, tokens, lengths, _ in _blocks(batches, []):
            pairs = tokens[:-1] << 32 | tokens[1:]
            pairs, counts = np.unique(np.delete(pairs, np.cumsum(lengths)[:-1] - 1), return_counts=True)
            h = ids.hashes()
            u, w = h[pairs >> 32], h[pairs & 0xFFFFFFFF]
            shard = _shard(u, w, hot, shards)
            order = np.lexsort((w, u, shard))
            u, w, counts, shard = u[order], w[order], counts[order].astype("<u4"), shard[order]  # a block has fewer tokens than 32 bits count
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            out, held = [], 0
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                contexts, runs = np.unique(u[i:j], return_counts=True)
                head = np.array([len(contexts), j - i], dtype="<u8")
                out.append((int(shard[i]), b"".join(x.tobytes() for x in (head, contexts, runs.astype("<u4"), w[i:j], counts[i:j]))))
                held += len(out[-1][1])
                if held >= BLOB_BYTES:
                    yield pd.DataFrame(out, columns=["shard", "data"])
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["shard", "data"])

    return run


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
    contexts = np.frombuffer(data, "<u8", m, 16)
    runs = np.frombuffer(data, "<u4", m, 16 + 8 * m)
    return np.repeat(contexts, runs), np.frombuffer(data, "<u8", n, 16 + 12 * m), np.frombuffer(data, "<u4", n, 16 + 12 * m + 8 * n)


def _save(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _merge(folder: str):
    """Writes a shard's pairs and returns what they say of their words: kind, key, n1, n2, n3, total; kind 3: how many a shard has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> Iterator[pd.DataFrame]:
            parts = [_unblob(x) for x in held]
            held.clear()
            u, w, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
            parts.clear()
            key = pair_key(u, w)
            order = np.argsort(key)
            key, u, w = key[order], u[order], w[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            c = np.add.reduceat(c[order].astype(np.int64), starts)
            key, u, w = key[starts], u[starts], w[starts]
            _save(f"{folder}/pair-{at:06d}-key.npy", key)
            _save(f"{folder}/pair-{at:06d}-count.npy", c.astype(np.min_scalar_type(int(c.max(initial=0)))))
            yield pd.DataFrame({"kind": [3], "key": [at], "n1": [0], "n2": [0], "n3": [0], "total": [len(key)]})
            of_counts = np.bincount(np.minimum(c, 5), minlength=6)
            yield pd.DataFrame({"kind": [0], "key": [0], "n1": [of_counts[1]], "n2": [of_counts[2]], "n3": [of_counts[3]], "total": [of_counts[4]]})
            words_, where = np.unique(u, return_inverse=True)
            n1, n2, n3 = (np.bincount(where, weights=x).astype(np.int64) for x in (c == 1, c == 2, c >= 3))
            yield pd.DataFrame({"kind": 1, "key": words_.view(np.int64), "n1": n1, "n2": n2, "n3": n3, "total": np.bincount(where, weights=c).astype(np.int64)})
            words_, where = np.unique(w, return_inverse=True)
            yield pd.DataFrame({"kind": 2, "key": words_.view(np.int64), "n1": 0, "n2": 0, "n3": 0, "total": np.bincount(where)})

        for b in batches:
            for shard, data in zip(b["shard"], b["data"], strict=True):
                if shard != at:
                    if held:
                        yield from done()
                    at = shard
                held.append(data)
        if held:
            yield from done()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more; where a count of counts is missing, half of what is left to take."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n3 else 2 * d1
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else d2
    return tuple(min(max(d, 0.0), k - 1e-3) for k, d in zip((1, 2, 3), (d1, d2, d3), strict=True))


def _word_arrays(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            key = rows["key"].to_numpy().view(np.uint64)
            order = np.argsort(key)
            _save(f"{folder}/word-{at:06d}-key.npy", key[order])
            _save(f"{folder}/word-{at:06d}-values.npy", rows[["c", "total", "mass", "p1"]].to_numpy(np.float64)[order])
            return pd.DataFrame({"shard": [at], "n": [len(key)]})

        for b in batches:
            for shard, rows in b.groupby("shard", sort=True):
                if shard != at:
                    if held:
                        yield done()
                    at = shard
                held.append(rows)
        if held:
            yield done()

    return run


def train(docs: DataFrame) -> Model:
    """Counts all texts of docs and writes the model to the shared folder."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = mounted(new_folder(spark, "lm"))
    os.makedirs(folder)
    counts = stored(_texts(docs).mapInPandas(tidy(_word_counts), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    n, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    share = max(TOKENS_PER_SHARD, n // MOST_SHARDS)
    hot = tuple(sorted(r.w & (1 << 64) - 1 for r in counts.where(F.col("c") > share).collect()))  # fewer than n / share, which MOST_SHARDS bounds
    # every text begins with START: its context is as frequent as the end, and may be too
    hot = tuple(sorted({*hot, word_hash(START)}))
    pair_shards = max(LEAST_SHARDS, n // share)
    blobs = _texts(docs).mapInPandas(tidy(_pair_blobs(np.array(hot, dtype=np.uint64), pair_shards)), "shard long, data binary")
    stats = blobs.repartition(parts, "shard").sortWithinPartitions("shard").mapInPandas(tidy(_merge(folder)), "kind int, key long, n1 long, n2 long, n3 long, total long")
    stats = stored(stats.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total")]), "stats", few=True)
    of = next(iter(stats.where("kind = 0").select("n1", "n2", "n3", "total").collect()), (0, 0, 0, 0))
    d = discounts(*of)
    k = F.col("total")
    c = stats.where("kind = 2").agg(*[F.coalesce(F.sum((k == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)], F.coalesce(F.sum((k >= 3).cast("long")), F.lit(0)), F.coalesce(F.sum(k), F.lit(0))).first()
    e, total = discounts(*c[:4]), c[5]
    spread = (e[0] * c[0] + e[1] * c[1] + e[2] * c[4]) / total if total else 1.0
    unknown = spread / (types + 1)
    cut = F.when(k == 1, e[0]).when(k == 2, e[1]).otherwise(e[2])
    right = stats.where("kind = 2").select(F.col("key").alias("w"), ((k - cut) / F.lit(float(total or 1)) + unknown).alias("p1"))
    left = stats.where("kind = 1").select(F.col("key").alias("w"), "total", ((F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / k).alias("mass"))
    word_shards = max(LEAST_SHARDS, types // share)
    every = counts.join(right, "w", "full").join(left, "w", "full").select(F.col("w").alias("key"), F.coalesce("c", F.lit(0)).cast("double").alias("c"), F.coalesce("total", F.lit(0)).cast("double").alias("total"), F.coalesce("mass", F.lit(1.0)).alias("mass"), F.coalesce("p1", F.lit(unknown)).alias("p1"))
    every = every.withColumn("shard", F.pmod("key", F.lit(word_shards)))
    words = every.repartition(parts, "shard").sortWithinPartitions("shard").mapInPandas(tidy(_word_arrays(folder)), "shard long, n long").collect()  # a row for each shard
    pairs = stats.where("kind = 3").select(F.col("key").alias("shard"), F.col("total").alias("n")).collect()
    return Model(folder, pair_shards, word_shards, hot, d, unknown, int(n), int(types), {("pair", r.shard): r.n for r in pairs} | {("word", r.shard): r.n for r in words})


class Reader:
    """Lookups in the model's arrays; each is mapped into memory when it is needed, the OPEN last used at once."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, OrderedDict()

    def array(self, name: str) -> np.ndarray | None:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path = f"{self.model.folder}/{name}.npy"
        found = self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        if len(self.open) > OPEN:
            self.open.popitem(last=False)
        return found

    def look(self, kind: str, values: str, shard: np.ndarray, key: np.ndarray, out: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, shard))
        at = shard[order]
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            stem, n = f"{kind}-{int(at[i]):06d}", self.model.lengths.get((kind, int(at[i])), 0)
            if not n:
                continue
            keys, found = self.array(f"{stem}-key"), self.array(f"{stem}-{values}")
            if keys is None or found is None or not len(keys) == len(found) == n:
                raise FileNotFoundError(f"{self.model.folder}: {stem} of the model isn't there as it was written; driver and executors need one shared folder")
            asked = key[order[i:j]]
            places = np.minimum(np.searchsorted(keys, asked), n - 1)
            hit = keys[places] == asked
            out[order[i:j][hit]] = found[places[hit]]
        return out

    def words(self, h: np.ndarray) -> np.ndarray:
        """count, context total, back-off mass, continuation probability."""
        out = np.tile(np.array([0.0, 0.0, 1.0, self.model.unknown]), (len(h), 1))
        signed = h.view(np.int64)
        return self.look("word", "values", np.mod(signed, self.model.word_shards), h, out)

    def pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        shard = _shard(u, w, np.array(self.model.hot, dtype=np.uint64), self.model.pair_shards)
        return self.look("pair", "count", shard, pair_key(u, w), np.zeros(len(u), dtype=np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, d = Reader(model), np.array([0.0, *model.discounts])
        for ids, tokens, lengths, rows in _blocks(batches, ["doc_id"]):
            h = ids.hashes()
            known = reader.words(h)
            ends = np.cumsum(lengths)
            u, w = np.delete(tokens, ends - 1), np.delete(tokens, ends - lengths)
            pairs, where = np.unique(u << 32 | w, return_inverse=True)
            pu, pw = pairs >> 32, pairs & 0xFFFFFFFF
            c = reader.pairs(h[pu], h[pw])
            total = known[pu, 1]
            p = np.where(total > 0, (c - d[np.minimum(c, 3)]) / np.maximum(total, 1) + known[pu, 2] * known[pw, 3], known[pw, 3])
            base = np.log10((known[:, 0] + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            first = np.cumsum(lengths - 1) - (lengths - 1)
            score = np.add.reduceat(np.log10(p)[where], first)
            yield pd.DataFrame({
                "doc_id": pd.array([r[0] if not pd.isna(r[0]) else None for r in rows], dtype="Int64"),
                "n_tokens": lengths - 1,
                "n_known": np.add.reduceat((known[:, 0] > 0)[w].astype(np.int64), first),
                "base_score": np.add.reduceat(base[w], first),
                "score": score,
                "perplexity": 10 ** np.minimum(-score / (lengths - 1), 300),
            })

    return _texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInPandas(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id")) != 1))
    rows = scored(docs, model)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
