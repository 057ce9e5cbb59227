"""Texts with their labels opened again, in one pass over text and labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What can be a label, with the number that tells it from another one of the same digits.
LABEL = re.compile(r"(<<[^<>]+>>(?:_\d+)?)")


def open_labels(text: str | None, pairs: list[dict]) -> str | None:
    """text with the value of each label (pairs of placeholder, value, nests) in its place.

    Text is parted at labels once, and so is each value that nests when it is met: what is left of the outer text waits on
    a stack. A label within its own value stays. So the work follows the length of what comes out.
    """
    if text is None or not pairs:
        return text
    known: dict[str, tuple[str, bool]] = {}
    for p in pairs:
        known.setdefault(p["placeholder"], (p["value"], bool(p["nests"])))
    out: list[str] = []
    stack: list[tuple[str | None, Iterator[str]]] = [(None, iter(LABEL.split(text)))]
    inside: set[str | None] = set()
    while stack:
        name, parts = stack[-1]
        for part in parts:
            bare = part
            if part not in known and part.startswith("<<") and not part.endswith(">>"):
                bare = part[: part.rfind(">>") + 2]  # a label before an underscore and digits of the text's own
            found = known.get(bare)
            if found is None or bare in inside:
                out.append(part)
                continue
            value, nests = found
            if nests and "<<" in value:
                inside.add(bare)
                stack.append((bare, iter([*LABEL.split(value), part[len(bare) :]])))
                break
            out.append(value + part[len(bare) :])
        else:
            stack.pop()
            inside.discard(name)
    return "".join(out)


def _open(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, pairs in batches:
        yield pd.Series([open_labels(t, [] if p is None else list(p)) for t, p in zip(texts, pairs, strict=True)], dtype=object)


def opened(text: Column, pairs: Column) -> Column:
    """open_labels() of a column; pairs: array<struct<placeholder, value, nests>>."""
    return F.pandas_udf(_open, "string")(text, pairs)
