"""Rows that the tests share."""

from __future__ import annotations

#: Nulls, empty and long texts, a repeated row, a row without id.
ODD = [(1, None), (2, ""), (3, "one"), (4, " \t\n"), (5, "same text here"), (5, "same text here"), (None, "no id"), (6, "word " * 3000), (7, "x" * 20000), (8, "Ä ö 😀 " * 40)]


def stories(n, words=120, seed=0, vocabulary=2000):
    import random

    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]
