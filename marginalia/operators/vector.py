"""Cosine search and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.operators import lexical
from marginalia.operators.ranking import diversified, note_cap

RRF = 60
#: Queries are searched in blocks of so many: what every task holds of them is bounded.
MOST_QUERIES = 20_000
#: Rows and queries that are multiplied at once.
_ROWS, _COLUMNS = 4096, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if their lengths differ or one is null, empty or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def current_vectors(vectors: DataFrame) -> DataFrame:
    """The row of the highest run of every chunk: chunk_id, h, v."""
    return vectors.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max_by(F.struct("h", "v"), F.struct("run_id", "h")).alias("s")).select("chunk_id", "s.*")


def _unit(rows: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``size`` finite numbers that are not all zero, normalised, and where they stood."""
    at = [i for i, v in enumerate(rows) if v is not None and len(v) == size and None not in v]
    x = np.array([rows[i] for i in at], np.float64).reshape(len(at), size)
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok] / norm[ok, None], np.array(at, np.int64)[ok]


def _best(score: np.ndarray, ids: np.ndarray, notes: np.ndarray, limit: int, cap: int) -> np.ndarray:
    """Which rows of a batch can be on a query's page, whatever other batches hold.

    Rows are ordered as on the page; a score below 0 is no match. Kept are the best ``limit`` rows that are among the first ``cap`` of their note here and,
    if there are fewer, the best ``limit`` of those further behind in their note. Every row of the whole page is
    among them: a row that is passed over here has ``limit`` rows before it that the whole page places before it too.
    """
    good = np.flatnonzero(score >= 0)
    if len(good) > 16 * limit:
        worst = np.partition(score[good], len(good) - 16 * limit)[len(good) - 16 * limit]
        for some in (good[score[good] >= worst], good):
            kept, full = _capped(score, ids, notes, some, limit, cap)
            if full or some is good:
                return kept
    return _capped(score, ids, notes, good, limit, cap)[0]


def _capped(score: np.ndarray, ids: np.ndarray, notes: np.ndarray, some: np.ndarray, limit: int, cap: int) -> tuple[np.ndarray, bool]:
    seen: dict[object, int] = {}
    first, behind = [], []
    for i in some[np.lexsort((ids[some], -score[some]))]:
        n = seen[notes[i]] = seen.get(notes[i], 0) + 1
        if n <= cap:
            first.append(i)
            if len(first) == limit:
                return np.array(first, np.int64), True
        elif n <= limit and len(behind) < limit:
            behind.append(i)
    return np.array(first + behind, np.int64), False


def search(stored: DataFrame, queries: DataFrame, limit: int = 8, cap: int | None = None) -> DataFrame:
    """The page of a stated query set (query_id, qv) over all stored vectors (chunk_id, note_path, v): query_id, rank, chunk_id, note_path, score.

    Queries go to the tasks in blocks of MOST_QUERIES; every batch of stored vectors is multiplied with them and gives only
    the rows that can be on a page (see :func:`_best`), so what is shuffled is a few rows a query and batch. Null, empty,
    zero and NaN vectors, and vectors of another length than the query's, match nothing. Null query ids are left out.
    """
    cap = cap or note_cap(limit)
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *stored.schema]}
    ddl = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, note_path {kind['note_path']}, score double"
    asked = queries.where(F.col("query_id").isNotNull() & (F.size("qv") > 0)).select("query_id", F.col("qv").cast("array<double>").alias("qv"))
    blocks = max(1, -(-asked.count() // (MOST_QUERIES // 2)))
    held = asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))) if blocks > 1 else asked.withColumn("__block", F.lit(0))
    rows = stored.select("chunk_id", "note_path", F.col("v").cast("array<double>").alias("v"))
    out = None
    for block in range(blocks):
        some = held.where(F.col("__block") == block).select("query_id", "qv").toArrow()
        names, vectors = some.column(0).to_pylist(), some.column(1).to_pylist()
        by_size = {}
        for size in sorted({len(v) for v in vectors}):
            unit, at = _unit(vectors, size)
            by_size[size] = unit, [names[i] for i in at]
        sent = stored.sparkSession.sparkContext.broadcast(by_size)

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, _ROWS):
                    b = whole.slice(lo, _ROWS)
                    v = b.column(2).to_pylist()
                    ids, notes = (np.array(b.column(i).to_pylist(), object) for i in (0, 1))
                    got: list[tuple[object, int, float]] = []
                    for size, (q, named) in sent.value.items():
                        x, at = _unit(v, size)
                        if not len(at):
                            continue
                        order = np.argsort(ids[at])
                        place = np.empty(len(at), np.int64)
                        place[order] = np.arange(len(at))
                        for c in range(0, len(named), _COLUMNS):
                            score = x @ q[c : c + _COLUMNS].T
                            shown = np.where(score > 0, np.round(score, 6), -1.0)
                            for j in range(score.shape[1]):
                                got += [(named[c + j], at[i], score[i, j]) for i in _best(shown[:, j], place, notes[at], limit, cap)]
                    take = pa.array([i for _, i, _ in got], pa.int64())
                    yield pa.record_batch([pa.array([n for n, _, _ in got], type=some.schema.field(0).type), b.column(0).take(take), b.column(1).take(take), pa.array([s for _, _, s in got], pa.float64())], names=["query_id", "chunk_id", "note_path", "score"])

        found = rows.mapInArrow(compare, ddl)
        out = found if out is None else out.unionByName(found)
    return diversified(out, limit, cap).select("query_id", "rank", "chunk_id", "note_path", "score")


def fuse(lexical_page: DataFrame, vector_page: DataFrame, limit: int, cap: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two candidate lists (query_id, rank, chunk_id, note_path); ties: vector hits by their rank, then lexical ones."""
    l = lexical_page.select("query_id", "chunk_id", "note_path", F.col("rank").alias("lrank"), F.lit(None).cast("int").alias("vrank"))
    v = vector_page.select("query_id", "chunk_id", "note_path", F.lit(None).cast("int").alias("lrank"), F.col("rank").alias("vrank"))
    both = l.unionByName(v).groupBy("query_id", "chunk_id", "note_path").agg(F.max("lrank").alias("lrank"), F.max("vrank").alias("vrank"))
    score = F.coalesce(1 / (RRF + F.col("lrank")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("vrank")), F.lit(0.0))
    order = [F.desc(F.round("score", 9)), F.coalesce("vrank", F.lit(1 << 30)), F.coalesce("lrank", F.lit(1 << 30))]
    return diversified(both.withColumn("score", score), limit, cap, order).select("query_id", "rank", "chunk_id", "note_path", "score", "lrank", "vrank")


def hybrid(chunks: DataFrame, stored: DataFrame, queries: DataFrame, limit: int = 8, cap: int | None = None) -> DataFrame:
    """Hybrid search of ``queries`` (query_id, query, qv); a query without a vector keeps its lexical order."""
    depth = max(4 * limit, 20)
    words = lexical.search(chunks, queries, depth)
    vectors = search(stored, queries.where(F.col("qv").isNotNull()).select("query_id", "qv"), depth)
    return fuse(words, vectors, limit, cap)


def centroid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per key as rows: key, i, x. A vector that is too short counts as 0 there."""
    flat = rows.where(F.size(vector) > 0).select(key, F.posexplode(vector).alias("i", "x"))
    n = rows.where(F.size(vector) > 0).groupBy(key).agg(F.count("*").alias("n"))
    return flat.groupBy(key, "i").agg(F.sum("x").alias("s")).join(n, key).select(key, "i", (F.col("s") / F.col("n")).alias("x"))


def top_ranks(scored: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    order = W.Window.partitionBy(query).orderBy(F.desc(F.round("score", 6)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
