"""The byte cut against Python's, over all documents."""

from oracle import views

from umbra import plans


def test_byte_truncated(spark, sf_dir):
    rows = views(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()
    cut = lambda t: t if t is None or len(t.encode()) <= 300 else t.encode()[:300].decode("utf-8", "replace") + "\n...[truncated]"
    got = [(r.doc_id, r.cut) for r in plans.QUERIES["byte_truncated"](spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(((d, cut(t)) for d, t in rows), key=repr)
    assert any(t and not t.isascii() for _, t in rows)
