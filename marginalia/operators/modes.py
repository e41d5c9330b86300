"""Which way a search goes, and searches that are overtaken or take too long."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import lexical, vector
from marginalia.operators.embed import Provider, checked

LEXICAL, VECTOR, HYBRID = "lexical", "vector", "hybrid"


def effective_mode(configured: str, provider: Provider | None) -> str:
    """Without a provider every search is lexical."""
    return configured if provider is not None and configured in (VECTOR, HYBRID) else LEXICAL


def query_vectors(queries: list[str], provider: Provider | None, configured: str, stored_identity: str | None, identity: str) -> list[list[float] | None]:
    """A vector for every query, or none for all: without provider, in lexical mode, if the stored vectors are missing or of
    another identity (their cosines would mean nothing), or if the provider fails."""
    if effective_mode(configured, provider) == LEXICAL or stored_identity is None or stored_identity != identity:
        return [None] * len(queries)
    try:
        return checked(provider(queries), len(queries)) if queries else []
    except Exception:
        return [None] * len(queries)


def search(index: lexical.Index, stored: DataFrame, queries: DataFrame, configured: str, provider: Provider | None, stored_identity: str | None, identity: str, limit: int = 8) -> DataFrame:
    """The pages of ``queries`` (query_id, query; a bounded set of at most vector.MOST_QUERIES): query_id, rank, chunk_id, note_path, score.

    Hybrid search without a query vector keeps the lexical order; vector search without one finds nothing."""
    mode = effective_mode(configured, provider)
    cols = ["query_id", "rank", "chunk_id", "note_path", "score"]
    if mode == LEXICAL:
        return lexical.search(index, queries, limit).select(*cols)
    rows = queries.limit(vector.MOST_QUERIES + 1).collect()
    if len(rows) > vector.MOST_QUERIES:
        raise ValueError(f"more than {vector.MOST_QUERIES} queries at once: embed them with embed.embedded and use vector.hybrid")
    vectors = query_vectors([r["query"] for r in rows], provider, configured, stored_identity, identity)
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}
    asked = queries.sparkSession.createDataFrame([(r["query_id"], r["query"], v) for r, v in zip(rows, vectors, strict=True)], f"query_id {kind['query_id']}, query string, qv array<double>")
    if mode == VECTOR:
        return vector.search(stored, asked.where(F.col("qv").isNotNull()), limit).select(*cols)
    return vector.hybrid(index, stored, asked, limit).select(*cols)


def require_indexed(chunks: DataFrame, note_path: str) -> DataFrame:
    """The chunks of a note of the index; a note without any is refused, so nothing outside the index can be read."""
    own = chunks.where(F.col("note_path") == note_path)
    if own.isEmpty():
        raise LookupError(f"not in the index: {note_path}")
    return own


def within(seconds: float, work: Callable[[], Any]) -> Any:
    """The result of ``work``, or TimeoutError; work that is too late is abandoned, not stopped."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(work).result(seconds)
    except Late:
        raise TimeoutError(f"no answer within {seconds} s") from None
    finally:
        pool.shutdown(wait=False)


class Newest:
    """Searches of one asker: a new one cancels the jobs of the one before, whose result is dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._number, self._tag = spark, threading.Lock(), 0, None

    def run(self, work: Callable[[], Any]) -> tuple[bool, Any]:
        """(True, result), or (False, None) if a newer search began meanwhile."""
        with self._lock:
            self._number += 1
            mine, old = self._number, self._tag
            self._tag = tag = f"search-{uuid.uuid4().hex}"
        if old:
            self.spark.sparkContext.cancelJobsWithTag(old)
        self.spark.sparkContext.addJobTag(tag)
        try:
            result = work()
        except Exception:
            if mine == self._number:
                raise
            return False, None
        finally:
            self.spark.sparkContext.removeJobTag(tag)
        return (True, result) if mine == self._number else (False, None)
