"""Duplicates hidden by formatting: collapse equal rows, canonicalise the distinct ones, collapse again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.skew import lookup
from marginalia.session import materialize

_FIELD = "[^:=;\\n{}\"]++[:=]"
_JSON = "map<string,string>"


def bare(c: Column) -> Column:
    """Letters and digits in order, whatever their case; null is empty."""
    return F.replace(F.lower(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]++", ""))), F.lit("ß"), F.lit("ss"))


def fields(content: Column) -> Column:
    """The canonical fields of a content that is a JSON object or consists wholly of ``key: value`` or ``key=value`` fields.

    Null unless there are two fields or more. Fields stand on lines or between semicolons; a blank one is ignored. Each
    becomes its letters and digits, and the list is sorted, so their order does not matter.
    """
    body = F.btrim(content, F.lit(" \t\r\n "))
    as_json = F.from_json(F.when(body.startswith("{") & body.endswith("}"), body), _JSON)
    pairs = F.transform(F.map_entries(as_json), lambda e: F.concat(bare(e["key"]), bare(e["value"])))
    parts = F.filter(F.transform(F.split(body, "[\\r\\n;]+"), lambda p: F.btrim(p, F.lit(" \t "))), lambda p: p != "")
    listed = F.when(F.forall(parts, lambda p: p.rlike(f"(?U)^{_FIELD}")), F.transform(parts, bare))
    found = F.array_sort(F.coalesce(F.when(F.size(as_json) > 0, pairs), listed))
    return F.when(F.size(found) >= 2, found)


def shapes(entries: DataFrame, key: str, text: str, *labels: str) -> tuple[DataFrame, DataFrame]:
    """(raw, forms): the distinct raw rows with key ``rep`` and copies; and each with its canonical ``label`` and ``form``."""
    names = [f"c{i}" for i in range(1 + len(labels))]
    own = entries.select(F.col(key).alias("key"), *[F.col(c).alias(n) for c, n in zip((text, *labels), names, strict=True)])
    raw = own.where(F.col("key").isNotNull()).groupBy(*names).agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    label = F.concat_ws("\u0001", *[bare(F.col(n)) for n in names[1:]])
    forms = raw.select("rep", "copies", label.alias("label"), bare(F.col("c0")).alias("bare"), fields(F.col("c0")).alias("fields"))
    shape = forms.where("fields is not null").groupBy("label", "bare").agg(F.max_by("fields", F.struct(F.size("fields"), "fields")).alias("shape"))
    formed = forms.join(shape, ["label", "bare"], "left")
    return raw, formed.select("rep", "copies", "label", F.coalesce(F.array_join("shape", "\u0002"), "bare").alias("form"))


def classes(entries: DataFrame, key: str, text: str, *labels: str) -> DataFrame:
    """One row a class of equal records: first (its smallest key), copies (records), variants (distinct raw rows).

    Records are equal if their labels and text agree in letters and digits, in order, whatever the case; null equals
    blank; and if the text consists of fields (see :func:`fields`), the same fields in any order agree, as does a text that
    equals one of the orders. Identical raw rows collapse first, with counts combined on the map side, so a text copied a
    billion times is canonicalised once; then the full canonical texts are grouped and the counts summed. Rows with a null
    key are no records. Empty tables give no rows.
    """
    _, forms = shapes(entries, key, text, *labels)
    return forms.groupBy("label", "form").agg(F.min("rep").alias("first"), F.sum("copies").alias("copies"), F.count("*").alias("variants"))


def members(entries: DataFrame, key: str, text: str, *labels: str) -> DataFrame:
    """The class of every record that has copies: first (the smallest key of the class) and the key column, each record once.

    Only classes of several records are looked up; their rows meet their class on the raw columns, frequent ones by
    broadcast (see :func:`marginalia.operators.skew.lookup`)."""
    raw, forms = shapes(entries, key, text, *labels)
    formed = forms.groupBy("label", "form").agg(F.min("rep").alias("first"), F.sum("copies").alias("n"))
    reps = forms.select("rep", "label", "form").join(formed.where("n > 1"), ["label", "form"]).select("rep", "first")
    names = [f"c{i}" for i in range(1 + len(labels))]
    fingerprint = F.sha2(F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}), 256)
    known = raw.join(reps, "rep").select(fingerprint.alias("print"), "first")
    own = entries.select(F.col(key), *[F.col(c).alias(n) for c, n in zip((text, *labels), names, strict=True)]).where(F.col(key).isNotNull())
    printed = materialize(own.select(key, fingerprint.alias("print")), "fingerprints")  # read for the hot ones, and by both joins
    return lookup(printed, known, "print", "inner").select("first", key).distinct()
