"""Mixing sources to target weights: token totals, repetition rates, whole copies and one seeded fractional copy."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More targets than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST_SOURCES = 10_000
_BUCKETS = 1 << 31
#: How texts are cut before byte pairs are merged (fixed value of the public vocabulary).
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def whitespace_tokens(text: Column) -> Column:
    """Number of whitespace-separated tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("(?U)\\S++")), F.lit(0))


def bpe_tokens(vocabulary: str, pattern: str) -> object:
    """A Column function that counts tokens of a public byte-level BPE; ``vocabulary`` is the path of its ranks (base64 token, rank)."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count


def source_rates(documents: DataFrame, targets: DataFrame, tokens: Column | None = None) -> DataFrame:
    """The plan of a mix, one row a target source: source, target_share, max_repeats, tokens, wanted, rate, capped.

    ``wanted`` is the target share of all tokens of the documents whose source is a target; ``rate`` is how often each
    document is to be used, at most ``max_repeats``; ``capped`` says that the cap keeps the source below its target.
    Documents of null or other sources are no part of the mix; a source without tokens is capped at rate 0 if it should
    have any. Repeated target rows count once (the largest share). No documents: nothing is wanted.
    """
    tokens = whitespace_tokens(F.col("text")) if tokens is None else tokens
    plan = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    sizes = documents.where(F.col("source").isNotNull()).select("source", tokens.alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"))
    known = plan.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    total = known.agg(F.sum("tokens").alias("s")).scalar()
    wanted = F.col("target_share") * F.coalesce(total, F.lit(0))
    return known.withColumn("wanted", wanted).select(
        "source",
        "target_share",
        "max_repeats",
        "tokens",
        "wanted",
        F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("tokens"))).otherwise(0.0).alias("rate"),
        (F.col("tokens") * F.col("max_repeats") < F.col("wanted")).alias("capped"),
    )


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """The mixed documents: doc_id, source, copy (from 1), tokens; a document is emitted floor(rate) times, plus once with the probability of the fraction.

    The draw is a hash of seed and doc_id: the same on every run and every partitioning. No shuffle of documents: the plan
    is broadcast as long as it is small (targets are a configuration table; its size is checked).
    """
    tokens = whitespace_tokens(F.col("text")) if tokens is None else tokens
    plan = source_rates(documents, targets, tokens).where("rate > 0").select("source", "rate")
    plan = F.broadcast(plan) if targets.count() <= MOST_BROADCAST_SOURCES else plan
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_BUCKETS)) / F.lit(float(_BUCKETS))
    whole = F.floor("rate")
    copies = (whole + (draw < F.col("rate") - whole).cast("long")).cast("int")
    own = documents.select("doc_id", "source", tokens.alias("tokens"))
    return own.join(plan, "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """What a mix reaches, one row a target source: the plan with mixed_tokens, documents and actual_share of all mixed tokens."""
    got = mix(documents, targets, seed, tokens).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.countDistinct("doc_id").alias("documents"))
    rows = source_rates(documents, targets, tokens).join(got, "source", "left").na.fill(0, ["mixed_tokens", "documents"])
    total = got.agg(F.sum("mixed_tokens").alias("s")).scalar()
    return rows.withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / total, F.lit(0.0)))
