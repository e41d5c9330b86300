"""Vectors from a provider: batches of texts in, checked matrices out; and a provider of signed hashed words for tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

Provider = Callable[[list[str]], list[list[float]]]
BATCH, MOST_BATCH = 16, 512


def checked(vectors: list[list[float]], expected: int) -> list[list[float]]:
    """A provider's answer: as many vectors as texts, finite numbers, one dimension."""
    if len(vectors) != expected or len({len(v) for v in vectors}) > 1 or any(not v for v in vectors):
        raise ValueError("the provider's answer has the wrong shape")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for v in vectors for x in v):
        raise ValueError("the provider's answer holds what is no number")
    return [[float(x) for x in v] for v in vectors]


def in_order(rows: list[dict], expected: int) -> list[list[float]]:
    """Vectors of rows that carry an ``index``: the indices must be 0 to n - 1, each once."""
    if sorted(r.get("index", -1) for r in rows) != list(range(expected)):
        raise ValueError("the provider's indices are no permutation")
    return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


def embedded(chunks: DataFrame, provider: Provider, batch: int = BATCH) -> DataFrame:
    """chunk_id, h, v of chunks (chunk_id, text): texts go to the provider in batches; any failure fails the job, so the stored vectors stay."""
    size = max(1, min(MOST_BATCH, batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(checked(provider(part.column(2).to_pylist()), part.num_rows), pa.list_(pa.float64()))], names=["chunk_id", "h", "v"])

    return chunks.where(F.col("text").isNotNull()).select("chunk_id", F.substring(F.md5("text"), 1, 16).alias("h"), "text").mapInArrow(run, "chunk_id string, h string, v array<double>")


def identity(provider: str, model: str, endpoint: str, key: str) -> str:
    """What makes stored vectors reusable; secrets enter as a hash."""
    import hashlib

    return ":".join([provider, model, *(hashlib.sha256(x.encode()).hexdigest()[:8] for x in (endpoint, key))])


def hashed_words(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, v: each word adds or takes one at the place its hash names; unit length, all zero without words. Inside the JVM; one row a row of ``key``."""
    h = F.conv(T.fnv1a(F.col("w")), 16, 10).cast("long")
    words = rows.select(key, F.explode(T.raw_tokens(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    placed = words.select(key, "n", h.alias("h")).select(key, (F.col("h") % dim).cast("int").alias("i"), F.when(F.col("h") % 2 == 1, F.col("n")).otherwise(-F.col("n")).alias("s"))
    sums = placed.groupBy(key, "i").agg(F.sum("s").cast("double").alias("s"))
    # a key has at most dim sums
    known = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    every = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("n") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n")).otherwise(0.0))
    return rows.select(key).join(known, key, "left").select(key, every.alias("v"))
