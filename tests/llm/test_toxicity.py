import random
import zlib

import numpy as np
from samples import ODD, stories
from pyspark.sql import functions as F

from umbra.llm import toxicity as X

CLEAN = [f"plain{i}" for i in range(400)]
FOUL = ["idiot", "trottel", "scum", "moron"]


def corpus(spark, n=600, seed=0):
    """Toxic texts hold foul words, some with endings or symbols; clean ones don't."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(CLEAN) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                f = r.choice(FOUL)
                w[r.randrange(80)] = r.choice([f, f + "en", f.upper() + "!!", f + "###", f.replace("o", "0")])
        docs.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    out = {r.doc_id: r for r in X.judged(docs, X.classifier(docs, labels)).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 300)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in X.judged(docs, X.classifier(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_other_columns_are_no_inputs(spark):
    docs, labels = corpus(spark, 300)
    model = X.classifier(docs, labels)
    a = {r.doc_id: r.score for r in X.judged(docs, model).collect()}
    b = {r.doc_id: r.score for r in X.judged(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang")), model).collect()}
    assert all(a[i] == b[i + 1000] for i in a)


def test_odd_rows(spark, odd, none):
    docs, labels = corpus(spark, 300)
    model = X.classifier(docs, labels)
    got = X.judged(odd, model)
    rows = got.collect()
    assert len(rows) == len(ODD) and set(got.columns) == {*odd.columns, "predicted"} and {r.score for r in rows if r.doc_id in (1, 2, 4)} == {rows[0].score}
    assert X.judged(none, model).count() == 0
    odd_labels = spark.createDataFrame([(None, 1, 1), (0, 1, None), (1, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert X.classifier(docs, odd_labels) is None and X.classifier(docs, labels.limit(0)) is None
    assert {r.score for r in X.judged(docs, None).collect()} == {0.0}


def test_isotonic():
    r = np.random.default_rng(0)
    x, y, w = r.random(200).round(2), r.integers(0, 2, 200).astype(float), r.random(200) + 0.1
    xs, ys = X.isotonic(x, y, w)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fit = np.interp(x, xs, ys)
    assert abs((w * fit).sum() - (w * y).sum()) < 1e-9 * w.sum() + 1e-6
    grid = np.sort(r.random(40))
    for _ in range(30):  # no other non-decreasing step function is nearer
        other = np.interp(x, np.linspace(0, 1, 40), grid := np.sort(r.random(40)))
        assert (w * (fit - y) ** 2).sum() <= (w * (other - y) ** 2).sum()


def test_trees_learn():
    r = np.random.default_rng(1)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    edges, trees, prior = X.boost(x, y, np.ones(2000))
    assert ((X.margins(x, edges, trees, prior) > 0) == (y > 0)).mean() > 0.97


def test_plain():
    assert X.plain("M0r0n!!!") == "moron" and X.plain("'idi.ot'") == "idiot" and X.plain("123") == "123" and X.plain("###") == ""


def slow_features(text, lexicon):
    """The features of one text, one token after the other."""
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(X.FEATURES)
    words = [X.plain(t) for t in tokens]
    weight = [max([lexicon.get(u, 0.0) for u in X.units(w)], default=0.0) for w in words]
    hits = [i for i in range(n) if weight[i] > 0]
    strong = [i for i in hits if weight[i] >= 3]
    address = [i for i in range(n) if words[i] in X.ADDRESS]
    near = sum(any(abs(i - j) <= 5 for j in address) for i in hits) / n
    chars = sum(map(len, tokens))
    letters = [sum(c.isalpha() for c in t) for t in tokens]

    def odd(t):
        core = X.EDGE.sub("", t)
        return bool(any(c.isalpha() for c in t) and core and not core.isalpha() and not "".join(c for c in core if c not in "'-’").isalpha())

    return [
        len(strong) / n, (len(hits) - len(strong)) / n, sum(weight) / n, max(sum(weight[i : i + X.STRETCH]) for i in range(max(1, n - X.STRETCH + 1))), len({tokens[i] for i in strong}), near, len(address) / n,
        sum(k > 1 and t.isupper() for k, t in zip(letters, tokens)) / n, sum(c.isupper() for c in text) / chars, sum(c in "!?" for c in text) / chars, sum(c in "$#@*%&" for c in text) / chars,
        sum(map(odd, tokens)) / n, sum(c.isdigit() for c in text) / chars, sum(bool(X.RUN.search(w)) for w in words) / n, np.log1p(n),
    ]


def test_features_one_by_one(spark, sf_dir):
    """The batch of features against a plain reading, on built texts and the small table's."""
    lexicon = {"=idiot": 4.0, "scum-": 3.5, "-oron": 2.0, "trot-": 1.6, "-rottel": 3.0}
    texts = ["You IDIOT!! scumbag, m0r0n $$ trottel.", "", None, "plain words; nothing, else. here:", "du Tro.ttel aaaargh it's co-op 12,5", " ".join(["you", "idiot"] * 60), "x. ,", "scumbags " * 3 + "ok " * 100]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    got = X.features(texts, X.Memo(lexicon))
    assert np.allclose(got, np.array([slow_features(t, lexicon) for t in texts]), atol=1e-9)


def test_parts_are_judged_by_others(spark):
    """A lexicon without a part holds no word that only this part's texts have; few rows take the same way as many."""
    docs, labels = corpus(spark, 90)
    model = X.classifier(docs, labels)
    assert model is not None and model.lexicon
    sample = spark.createDataFrame([(f"bad word{'xyz'[p]} " + " ".join(f"n{i}" for i in range(5)), 1, p) for p in range(3) for _ in range(8)] + [("fine words here", 0, p) for p in range(3) for _ in range(400)], "text string, toxic int, part int")
    made = X.lexicons(sample)
    assert all(f"=word{'xyz'[p]}" not in made[p] and f"=word{'xyz'[p]}" in made[3] and "=bad" in made[p] for p in range(3))


def test_the_bound_holds_for_rows_of_one_id(spark, made):
    """An id with many texts brings no more rows than the bound, and which ones doesn't depend on their order."""
    rows = [(1, t) for t in stories(300, words=15, seed=1)] + [(2, t) for t in stories(200, words=15, seed=2)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    once = X.labelled(made(rows), labels, positives=40, negatives=60).collect()
    again = X.labelled(made(rows[::-1]).repartition(3), labels, positives=40, negatives=60).collect()
    assert sorted(once) == sorted(again) and [sum(r.toxic == k for r in once) for k in (1, 0)] == [40, 60]
