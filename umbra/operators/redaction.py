"""Redaction: find secrets and personal data, replace them by deterministic placeholders, restore or forget them."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.patterns import anchored, let, marked, matched

DEFAULT_SALT = "change-me"
STRICT = ("strict", "gdpr", "dpdpa")


def entropy(s: Column) -> Column:
    """Shannon entropy over characters, in bits; 0.0 for an empty string."""
    def of(chars: Column) -> Column:
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - let(share(c), lambda p: p * F.log2(p)))

    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(let(F.split(s, ""), of))


def high_entropy(s: Column, threshold: float = 4.0) -> Column:
    return (F.length(s) >= 20) & (entropy(s) > threshold)


def placeholder(category: Column, value: Column, salt: str = DEFAULT_SALT) -> Column:
    return F.concat(F.lit("<<REDACTED_"), category, F.lit("_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16), F.lit(">>"))


def blake_placeholder(salt: str) -> Callable:
    """The same with a keyed BLAKE2b digest, as an Arrow function of category and value."""

    @F.pandas_udf("string")
    def of(category: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f"<<REDACTED_{c}_{hashlib.blake2b(v.encode(), key=salt.encode()[:64], digest_size=8).hexdigest()}>>" for c, v in zip(category, value, strict=True)])

    return of


def matches(text: Column) -> Column:
    """array<struct<category, value, tail>> led by one with a null category, whose tail precedes the first match."""
    pattern, categories = anchored()

    def one(part: Column) -> Column:
        groups, tail = matched(part)
        at = lambda g: F.array_position(F.transform(g, lambda x: x != ""), True).cast("int")
        return let(groups, lambda g: F.struct(F.element_at(F.array(*map(F.lit, categories)), at(g)).alias("category"), F.element_at(g, at(g)).alias("value"), tail.alias("tail")))

    parts = marked(text, pattern, len(categories))
    head = lambda p: F.array(F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("value"), p[0].alias("tail")))
    return let(parts, lambda p: F.concat(head(p), F.transform(F.slice(p, 2, F.size(p)), one)))


def redacted(text: Column, salt: str = DEFAULT_SALT, mode: str = "reference") -> Column:
    """struct<text, secrets: array<struct<category, placeholder, value>>> of a text; null and empty texts: '' and none.

    mode "reference": a quoted string of high entropy is replaced with its quotes, one of low entropy is left and uses
    up its place. mode "fixed": the quotes stay, and long hexadecimal strings need an entropy of 3 bits only.
    """
    if salt == DEFAULT_SALT:
        warnings.warn("redaction uses the default salt", stacklevel=2)

    def piece(m: Column) -> Column:
        quoted = m["category"] == "HIGH_ENTROPY_STRING"
        value = F.when(quoted, F.substring(m["value"], F.lit(2), F.length(m["value"]) - 2)).otherwise(m["value"])
        secret = high_entropy(value)
        if mode == "fixed":
            secret = secret | (value.rlike("^[0-9A-Fa-f]{32,}$") & high_entropy(value, 3.0))
        hidden = F.coalesce(~quoted | secret, F.lit(False))
        label = placeholder(m["category"], value, salt)
        quote = F.when(quoted, F.substring(m["value"], 1, 1)).otherwise("") if mode == "fixed" else F.lit("")
        out = F.when(hidden, F.concat(quote, label, quote)).otherwise(F.coalesce(m["value"], F.lit("")))
        return F.struct(F.concat(out, m["tail"]).alias("out"), F.when(hidden, F.struct(m["category"].alias("category"), label.alias("placeholder"), value.alias("value"))).alias("secret"))

    def whole(pieces: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(pieces, lambda x: x["out"]), "").alias("text"),
            F.filter(F.transform(pieces, lambda x: x["secret"]), lambda x: x.isNotNull()).alias("secrets"),
        )

    return let(F.transform(matches(F.coalesce(text, F.lit(""))), piece), whole)


def redact(corpus: DataFrame, text: str = "content", salt: str = DEFAULT_SALT, mode: str = "reference") -> DataFrame:
    """corpus with redacted (the safe text) and secrets; only texts with a match pay for more than one pass."""
    return corpus.withColumn("_r", redacted(F.col(text), salt, mode)).withColumns({"redacted": F.col("_r.text"), "secrets": F.col("_r.secrets")}).drop("_r")


def _each(corpus: DataFrame, *keys: str) -> DataFrame:
    """keys and s, each secret. Of an inner explode Spark infers filters on the array: redaction made twice more, below any exchange."""
    return corpus.select(*keys, F.explode_outer("secrets").alias("s")).where("s IS NOT NULL")


def secret_map(corpus: DataFrame, *keys: str) -> DataFrame:
    """A row for each key and distinct placeholder: category, placeholder, original."""
    rows = _each(corpus, *keys)
    return rows.select(*keys, F.col("s.category").alias("category"), F.col("s.placeholder").alias("placeholder"), F.col("s.value").alias("original")).distinct()


def events(corpus: DataFrame, *keys: str) -> DataFrame:
    """How many items of each category were hidden; never their values."""
    rows = _each(corpus, *keys)
    return rows.groupBy(*keys, F.col("s.category").alias("category")).agg(F.count("*").alias("n"))


def restored(text: Column, pairs: Column) -> Column:
    """text with each placeholder of pairs (array<struct<placeholder, value>>) replaced literally, longest first."""
    keyed = F.transform(pairs, lambda p: F.struct((-F.length(p["placeholder"])).alias("by"), p["placeholder"].alias("placeholder"), p["value"].alias("value")))
    return F.aggregate(F.array_sort(F.array_distinct(keyed)), text, lambda t, p: F.replace(t, p["placeholder"], p["value"]))


def forget(mapping: DataFrame, subjects: DataFrame, *keys: str) -> DataFrame:
    """The mapping without the subjects': their texts can't be restored any more."""
    return mapping.join(subjects.select(*keys).distinct(), list(keys), "left_anti")


def spliced(text: Column, spans: Column, salt: str = DEFAULT_SALT) -> Column:
    """text with named entities replaced from the right; spans: array<struct<start, end, label, value>>, start from 0.

    A span that begins with a placeholder was hidden before and stays.
    """
    def put(t: Column, s: Column) -> Column:
        here = F.substring(t, s["start"] + 1, s["end"] - s["start"])
        new = F.concat(F.substring(t, F.lit(1), s["start"]), placeholder(s["label"], s["value"], salt), F.substring(t, s["end"] + 1, F.length(t)))
        return F.when(here.startswith("<<REDACTED_"), t).otherwise(new)

    return F.aggregate(F.reverse(F.array_sort(spans)), text, put)


ENTITY = "array<struct<start:int,end:int,label:string,value:string>>"
#: What a model calls an entity, and the category it gets.
ENTITY_LABELS = {"PERSON": "NAME", "GPE": "LOCATION", "LOC": "LOCATION", "ORG": "ORGANIZATION", "DATE": "DATE"}


def entities(detect: Callable[[str], list[tuple[int, int, str, str]]], compliance: str = "global"):
    """An Arrow function text -> spans for a named-entity model; outside strict modes it finds none."""

    @F.pandas_udf(ENTITY)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[(s, e, ENTITY_LABELS[label], v) for s, e, label, v in detect(t or "") if label in ENTITY_LABELS] if compliance in STRICT else [] for t in batch])

    return of
