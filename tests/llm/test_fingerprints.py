import hashlib

from samples import stories
from pyspark.sql import functions as F

from umbra.llm import fingerprints as P


def test_syncmers_by_definition(spark):
    """The anchors are the k-mers whose smallest s-mer hash is at an edge, at their places."""
    text = stories(1, 60)[0] + " é😀 " + stories(1, 20, 3)[0]
    rows = spark.createDataFrame([(text,)], "t string")
    got = {a.pos for a in rows.select(P.anchors(F.col("t")).alias("a")).first().a}
    smers = [text[i : i + P.S] for i in range(len(text) - P.S + 1)]
    h = [r.h for r in spark.createDataFrame([(i, s) for i, s in enumerate(smers)], "i int, s string").orderBy("i").select(F.xxhash64("s").alias("h")).collect()]
    w = P.K - P.S + 1
    assert got == {i for i in range(len(text) - P.K + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])}


def test_edited_as_read_whole(spark, sf_dir):
    """What is taken over from the text and what is read after it make the fingerprint of the whole edited text."""
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    edited = {d: t[: len(t) - len(t) // 2] + docs[(i + 1) % len(docs)][1][: len(t) // 2] for i, (d, t) in enumerate(docs)}
    want = {r.doc_id: (r.fingerprint, hashlib.sha256(r.text.encode()).hexdigest()) for r in P.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    own = {r.doc_id: r.fingerprint for r in P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    got = P.op1_fingerprints(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.edited_fingerprint, r.edited_sha256) == want[r.doc_id] and r.fingerprint == own[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited > 0.15 for r in got) > 0.9 * len(got) and sum(r.near_next < 0.1 for r in got) > 0.9 * len(got)


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint) for r in P.fingerprints(odd).collect()]
    of = dict(got)
    assert of[1] == of[2] == "" and len(of[3]) == 8 and len(got) == 10
    assert [f for d, f in got if d == 5][0] == [f for d, f in got if d == 5][1]
    assert P.fingerprints(none).count() == 0


def test_next(made, none):
    rows = made([(i, f"t{i}") for i in range(300)] + [(None, "n"), (5, "again")])
    got = {(r.doc_id, r.text): r.next_text for r in P.with_next(rows, 20).where("NOT ahead").collect()}
    assert len(got) == 302 and got[(7, "t7")] == "t6" and got[(None, "n")] == "t299" and got[(0, "t0")] == "n"
    assert {got[(5, "t5")], got[(5, "again")], got[(6, "t6")]} == {"t4", "t5", "again"}
    assert P.with_next(made([(1, "a")])).where("NOT ahead").first().next_text == "a"
    assert P.with_next(none).count() == 0


def test_next_of_one_id(made, monkeypatch):
    """Thousands of rows without an id, or of one, are divided by their texts' hashes and still follow each other."""
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 16)
    rows = [(None, f"n{i}") for i in range(1500)] + [(7, f"s{i}") for i in range(1500)] + [(i, f"t{i}") for i in range(10, 60)]
    out = P.with_next(made(rows), 8)
    got = {(r.doc_id, r.text): r.next_text for r in out.where("NOT ahead").collect()}
    assert len(got) == 3050 and sorted(got.values()) == sorted(t for _, t in rows)
    assert all(got[(i, f"t{i}")] == f"t{i - 1}" for i in range(11, 60)) and got[(10, "t10")][0] == "s"
    assert sum(got[(None, f"n{i}")][0] == "n" for i in range(1500)) == 1499 and sum(got[(7, f"s{i}")][0] == "s" for i in range(1500)) == 1499
    assert out.groupBy("bucket").count().agg(F.max("count")).first()[0] < 200


def test_matches_by_place(made):
    """A text found inside another has its shift; two texts without a common anchor have none."""
    a, b, c = stories(3, 150, 71)
    docs = made([(1, a), (2, b + " " + a), (3, a[: len(a) // 2] + b[: len(b) // 2]), (4, c), (5, None), (6, "x y " * 500)])
    pairs = docs.sparkSession.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4), (1, 5), (6, 6)], "a long, b long")
    got = {(r.a, r.b): (r.shift, r.anchors) for r in P.matches(pairs, docs).collect()}
    assert got[(1, 2)][0] == len(b) + 1 and got[(2, 1)] == (-len(b) - 1, got[(1, 2)][1]) and got[(1, 3)][0] == 0
    assert set(got) == {(1, 2), (2, 1), (1, 3)} and got[(1, 2)][1] > 1.5 * got[(1, 3)][1]


def test_near_columns_by_sets(spark, sf_dir):
    """The likenesses against those of the fingerprints as sets, and the edited text's own likeness of all anchors."""
    def parts(f):
        return {f[i : i + 8] for i in range(0, len(f), 8)}

    def like(x, y):
        x, y = parts(x), parts(y)
        u = sorted(x | y)[: P.SIZE]
        return len(set(u) & x & y) / len(u) if u else 1.0

    got = sorted(P.op1_fingerprints(spark, sf_dir).collect(), key=lambda r: -r.doc_id)
    for r, following in zip(got, [*got[1:], got[0]], strict=True):
        assert abs(r.near_edited - like(r.fingerprint, r.edited_fingerprint)) < 1e-12
        if following.doc_id != r.doc_id:
            assert abs(r.near_next - like(r.fingerprint, following.fingerprint)) < 1e-12


def test_likeness(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([], [1])], "a array<long>, b array<long>")
    assert [r.l for r in rows.select(P.likeness(F.col("a"), F.col("b")).alias("l")).collect()] == [0.5, 1.0, 0.0]
