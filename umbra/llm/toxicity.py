"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon is learned: words, and beginnings and ends of words, that labelled toxic texts hold far oftener than clean
ones. Features of a text: how dense its strong and its weak hits are (over all words, and in the densest stretch), how
many hits stand near a word of address, and its rates of capitals, punctuation and obfuscation. Labels teach on a sample
of at most POSITIVES and NEGATIVES rows (those of lowest id hash), cross-fitted over PARTS parts by hash at every size: a
part's features come from the lexicon of the other parts, and its margins, which teach the calibration, from trees of the
other parts; the lexicon and the trees that judge are of all parts. Every text is scored whole. Id, language, source and
labels are inputs of no score.

Defined cases: null and empty texts have no words and all-zero features; null labels and ids teach nothing; of a label
given twice the toxic one counts; rows of one id all teach; without labels of both kinds, or without documents or labels,
every score is 0.0 (an empty table has none); equal texts have equal scores; a very long text is scored whole, its memory
eight bytes a word; other columns, whatever their names but score and predicted, are kept and matter to nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold, made, release, stored, table, tidy

POSITIVES, NEGATIVES, LEXICON, MEMO, HELD = 6000, 12000, 1024, 50_000, 200_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, PARTS = 80, 3, 0.15, 64, 5, 3
STRETCH = 32

#: Words of address in the corpus' languages.
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros os".split())
#: What stands for a letter inside a word.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGE = re.compile(r"^\W+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
RUN = re.compile(r"(.)\1{2,}")

FEATURES = ("strong", "weak", "weight", "stretch", "distinct", "near_address", "address", "capital_words", "capitals", "exclaim", "marks", "obfuscated", "digits", "long_runs", "log_words")


class Classifier(NamedTuple):
    lexicon: dict[str, float]
    edges: np.ndarray  # of bins, by feature
    trees: list  # feature, threshold and value arrays
    prior: float
    knots: tuple[np.ndarray, np.ndarray]


def plain(token: str) -> str:
    """A token without what surrounds or is put into it: lower case, look-alikes as letters where letters stand beside."""
    core = EDGE.sub("", token.lower())
    if core.isalpha():
        return core
    if any(c.isalpha() for c in core):
        core = INNER.sub("", core.translate(LOOKALIKE))
    return core


def units(word: str) -> list[str]:
    """What a lexicon may hold of a word: it whole, its beginnings and its ends."""
    n = len(word)
    return ["=" + word] + [word[:k] + "-" for k in (4, 5, 6) if n > k] + ["-" + word[-k:] for k in (4, 5, 6) if n > k] if word else []


class Memo(dict):
    """token -> row of `of`; each distinct token is looked at once."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.of = np.zeros((1024, 10))
        self.whole, self.heads, self.tails = ({u[cut]: x for u, x in lexicon.items() if kind(u)} for cut, kind in ((slice(1, None), lambda u: u[0] == "="), (slice(-1), lambda u: u[0] != "=" and u[-1] == "-" and u[0] != "-"), (slice(1, None), lambda u: u[0] == "-")))

    def weight(self, word: str) -> float:
        """The greatest of the word's units in the lexicon; none is 0."""
        best, n = self.whole.get(word, 0.0), len(word)
        for k in (4, 5, 6):
            if n <= k:
                break
            best = max(best, self.heads.get(word[:k], 0.0), self.tails.get(word[-k:], 0.0))
        return best

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.of):
            self.of = np.concatenate([self.of, np.zeros_like(self.of)])
        row, word = self.of[n], token[:-1] if token[-1] in ".,;:" else token
        if word.isalpha() and word.islower():  # most tokens: nothing else to see
            row[:] = 0
        else:
            word = plain(token)
            letters = sum(map(str.isalpha, token))
            core = EDGE.sub("", token)
            odd = bool(letters and core and not core.isalpha() and not core.replace("'", "").replace("-", "").replace("’", "").isalpha())
            row[2:8] = (letters > 1 and token.isupper(), sum(map(str.isupper, token)), token.count("!") + token.count("?"), sum(map(token.count, "$#@*%&")), odd, sum(map(str.isdigit, token)))
        row[0], row[1], row[8], row[9] = self.weight(word), word in ADDRESS, RUN.search(word) is not None, len(token)
        self[token] = n
        return n


def features(texts: list[str | None], memo: Memo) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    numbers = [np.fromiter(map(memo.__getitem__, (t or "").split()), dtype=np.int64) for t in texts]
    of = memo.of
    for i, k in enumerate(numbers):
        n = len(k)
        if not n:
            continue
        x = of[k]
        weight = x[:, 0]
        strong = weight >= 3
        hits = np.flatnonzero(weight > 0)
        address = np.flatnonzero(x[:, 1])
        near = 0.0
        if len(hits) and len(address):
            at = np.searchsorted(address, hits)
            gap = np.minimum(np.abs(address[np.minimum(at, len(address) - 1)] - hits), np.abs(address[np.maximum(at - 1, 0)] - hits))
            near = float((gap <= 5).sum()) / n
        run = np.cumsum(np.r_[0.0, weight])
        stretch = (run[STRETCH:] - run[:-STRETCH]).max() if n > STRETCH else run[-1]
        chars = max(1.0, x[:, 9].sum())
        strong_kinds = len(np.unique(k[strong]))
        out[i] = (strong.mean(), (weight > 0).mean() - strong.mean(), weight.mean(), stretch, strong_kinds, near, len(address) / n, x[:, 2].mean(), x[:, 3].sum() / chars, x[:, 4].sum() / chars, x[:, 5].sum() / chars, x[:, 6].mean(), x[:, 7].sum() / chars, x[:, 8].mean(), np.log1p(n))
    if len(memo) > MEMO:
        memo.clear()
    return out


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """unit, part, t, c: in how many toxic and clean texts; sums of some texts after another, HELD units at once."""
    counts, known = Counter(), {}

    def frames() -> Iterator[pd.DataFrame]:
        rows = list(counts.items())
        counts.clear()
        for i in range(0, len(rows), 50_000):
            some = rows[i : i + 50_000]
            yield pd.DataFrame({"unit": [k[0] for k, _ in some], "part": [k[1] for k, _ in some], "t": [n * k[2] for k, n in some], "c": [n * (1 - k[2]) for k, n in some]})

    for b in batches:
        for text, label, part in zip(b["text"], b["toxic"].tolist(), b["part"].tolist(), strict=True):
            found: set[str] = set()
            for token in set((text or "").split()):
                if token not in known:
                    if len(known) > MEMO:
                        known.clear()
                    known[token] = units(plain(token))
                found.update(known[token])
            counts.update([(u, part, label) for u in found])
            if len(counts) > HELD:
                yield from frames()
    yield from frames()


def lexicons(sample: DataFrame, parts: int = PARTS, size: int = LEXICON) -> list[dict[str, float]]:
    """Log-odds of units that hold in toxic texts (text, toxic, part) beyond doubt, the `size` surest: without each part, then of all."""
    texts = {r.part: (r.t, r.c) for r in sample.groupBy("part").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()}
    sums = [F.sum(F.when(F.col("part") == p, F.col(k)).otherwise(0)).alias(f"{k}{p}") for p in range(parts) for k in "tc"]
    rows = stored(sample.select("text", "toxic", "part").mapInPandas(tidy(_unit_counts), "unit string, part int, t long, c long").groupBy("unit").agg(*sums).where(" + ".join(f"t{p}" for p in range(parts)) + " >= 4"), "units", few=True)
    # so many are tried that chance alone gives some beyond a fixed bound: the bound follows their number
    bound = max(3.5, math.sqrt(2 * math.log(max(1, rows.count()))))
    out = []
    for without in [*range(parts), None]:
        of = [p for p in range(parts) if p != without]
        toxic, clean = (sum(texts.get(p, (0, 0))[i] for p in of) for i in (0, 1))
        if not toxic or not clean:
            out.append({})
            continue
        t, c = (sum((F.col(f"{k}{p}") for p in of), F.lit(0)) for k in "tc")
        x, y = (t + 0.5) / (toxic + 1.0), (c + 0.5) / (clean + 1.0)
        odds = F.log(x / (1 - x)) - F.log(y / (1 - y))
        sure = odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        best = rows.select("unit", t.alias("t"), odds.alias("odds"), sure.alias("sure")).where((F.col("t") >= 4) & (F.col("odds") > 1.5) & (F.col("sure") > bound)).orderBy(F.desc("sure"), "unit").limit(size).collect()
        out.append({r.unit: float(r.odds) for r in best})
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list, float]:
    """Histogram trees of fixed depth by second-order gain on log loss: bin edges, trees, prior."""
    edges = np.array([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    prior = float(np.log(p / (1 - p)))
    f, trees, reg = np.full(len(y), prior), [], 1.0
    for _ in range(TREES):
        q = _sigmoid(f)
        g, h = w * (y - q), w * q * (1 - q)
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, BINS, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)  # within its level
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            best = np.full(wide, 1e-6)
            for j in range(x.shape[1]):
                at = node * BINS + bins[:, j]
                gs, hs, ns = (np.bincount(at, weights=v, minlength=wide * BINS).reshape(wide, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better] = gain[np.arange(wide), top][better]
                feature[first : first + wide][better], cut[first : first + wide][better] = j, top[better]
            node = node * 2 + (bins[np.arange(len(y)), feature[first + node]] > cut[first + node])
        gs, hs = (np.bincount(node, weights=v, minlength=2**DEPTH) for v in (g, h))
        value = RATE * gs / (hs + reg)
        trees.append((feature, cut, value))
        f = f + value[node]
    return edges, trees, prior


def margins(x: np.ndarray, edges: np.ndarray, trees: list, prior: float) -> np.ndarray:
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    f, row = np.full(len(x), prior), np.arange(len(x))
    for feature, cut, value in trees:
        node = np.zeros(len(x), dtype=np.int64)
        for depth in range(DEPTH):
            at = 2**depth - 1 + node
            node = node * 2 + (bins[row, feature[at]] > cut[at])
        f += value[node]
    return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y by x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, low x, high x
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        if pools and pools[-1][3] == a:
            m = pools[-1]
            m[0], m[1] = (m[0] * m[1] + b * c) / (m[1] + c), m[1] + c
        else:
            pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, last = pools[-2], pools.pop()
            m[0], m[1], m[3] = (m[0] * m[1] + last[0] * last[1]) / (m[1] + last[1]), m[1] + last[1], last[3]
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    return xs, np.array([v for p in pools for v in (p[0], p[0])])


def labelled(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """text, toxic (0 or 1), part (0 to 3599) of the sample: positives and negatives rows of labels at most, so that it is broadcast."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    by = (F.xxhash64("labelled_id"), "labelled_id")
    chosen = known.where("label = 1").orderBy(*by).limit(positives).unionByName(known.where("label = 0").orderBy(*by).limit(negatives))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    # of copies and near copies one teaches: those with one least hash of five words in a row
    words = F.split(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+")
    copy = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 4)), lambda i: F.xxhash64(F.slice("words", i, 5))))
    first = joined.withColumn("words", words).withColumn("copy", copy).drop("words").groupBy("copy", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    first = first.select("label", "r.doc_id", F.coalesce("r.text", F.lit("")).alias("text"))
    # an id may have many rows: the bound holds for rows too
    within = (F.xxhash64("doc_id", "text"), "doc_id", "text")
    kept = first.where("label = 1").orderBy(*within).limit(positives).unionByName(first.where("label = 0").orderBy(*within).limit(negatives))
    return kept.select("text", F.col("label").alias("toxic"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3600)).cast("int").alias("part")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")


def train(sample: DataFrame, rate: float = 1.0, parts: int = PARTS) -> Classifier | None:
    """Cross-fitted: features of a part come from the lexicon of the others, its margins for the calibration from trees of the others.

    rate: how many clean rows each clean row of the sample stands for, against the toxic ones.
    """
    spark, since = sample.sparkSession, made(sample.sparkSession)
    sample = stored(sample.withColumn("part", F.col("part") % parts), "labelled", few=True)
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    words = lexicons(sample, parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memos = [Memo(words[p]) for p in range(parts)]
        for batch in batches:
            for part, rows in batch.groupby("part"):
                yield pd.DataFrame({"x": list(features(rows["text"].tolist(), memos[part])), "toxic": rows["toxic"], "part": rows["part"]})

    rows = sample.mapInPandas(tidy(run), "x array<double>, toxic int, part int").collect()  # the sample's bound
    dropped(spark, since)
    x, y, part = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.toxic for r in rows], dtype=np.float64), np.array([r.part for r in rows])
    order = np.lexsort((*x.T, y, part))
    x, y, part = x[order], y[order], part[order]
    w = np.where(y > 0, 1.0, rate)
    margin = np.zeros(len(y))
    for p in range(parts):
        own = part == p
        if own.any():
            margin[own] = margins(x[own], *boost(x[~own], y[~own], w[~own])) if (~own).any() else 0.0
    return Classifier(words[-1], *boost(x, y, w), isotonic(margin, y, w))


def judged(docs: DataFrame, model: Classifier | None, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*names)
    if model is None:
        return rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(model.lexicon)
        for texts in batches:
            x = features(texts.tolist(), memo)
            yield pd.Series(np.clip(np.interp(margins(x, model.edges, model.trees, model.prior), *model.knots), 0, 1) if len(x) else np.zeros(0))
        memo = None
        release()

    # not to be taken as deterministic: a filter by the score would be pushed below and compute it a second time
    score = F.pandas_udf(run, "double").asNondeterministic()
    return rows.withColumn("score", score(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classifier(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """Learned from the labels of the training folds."""
    known = labels.where(fold(F.col("doc_id")) != 0)
    n = known.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("c")).first()
    rate = (n.c / min(n.c, NEGATIVES)) / (n.t / min(n.t, POSITIVES)) if n.t and n.c else 1.0
    return train(labelled(docs, known), rate)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judged(docs, classifier(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
