from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from samples import ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def made(spark):
    """A table like documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).withColumns({c: F.lit(9) for c in ("score", "bucket", "key", "node", "fp", "size", "hash", "row", "h", "tie", "may", "ranges", "shortened", "predicted", "cut_id")})

    return build


@pytest.fixture(scope="session")
def odd(made):
    return made(ODD)


@pytest.fixture(scope="session")
def none(made):
    return made([])
