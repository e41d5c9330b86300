"""BM25 search over chunks, for many queries in one job."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import basename, tokens
from marginalia.operators.ranking import diversified
from marginalia.session import materialize, scratch_dir

K1, B, HEADING = 1.5, 0.75, 1.15
#: More query terms than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST_TERMS = 200_000


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk id once; of several rows that of the highest run, then the latest. One aggregation that keeps a row a chunk."""
    others = [c for c in chunks.columns if c != "chunk_id"]
    latest = F.max_by(F.struct(*others), F.struct(F.coalesce("run_id", F.lit(-1)), "indexed_at"))
    return chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(latest.alias("__row")).select(*[F.col(c) if c == "chunk_id" else F.col("__row")[c].alias(c) for c in chunks.columns])


def field_terms(note_path: Column, aliases: Column, heading_path: Column) -> Column:
    """Distinct terms of a chunk's file name (without its ending), aliases and ancestor headings."""
    name = F.array(F.regexp_replace(basename(note_path), "\\.[^.]+$", ""))
    empty = F.array().cast("array<string>")
    return F.array_distinct(tokens(F.array_join(F.concat(name, F.coalesce(aliases, empty), F.coalesce(heading_path, empty)), " ")))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf of the body."""
    return chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct terms of every query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


@dataclass(frozen=True)
class Index:
    """What searches read. ``facts``: one row a chunk (chunk_id, note_path, dl and the other short columns). ``postings``: one
    row a term of a chunk (term, chunk_id, note_path, dl, tf, in_head, in_field). ``df``: term, df (chunks with it in the
    body). ``n`` and ``avgdl``: number and mean length of the chunks. ``keep``: the chunks a search is confined to, or all."""

    facts: DataFrame
    postings: DataFrame
    df: DataFrame
    n: int
    avgdl: float | None
    keep: DataFrame | None = None

    def where(self, condition: Column) -> Index:
        """A search over the chunks that fulfil a condition on ``facts``; the statistics become those of these chunks."""
        kept = self.facts.where(condition)
        if self.keep is not None:
            kept = kept.join(self.keep, "chunk_id", "left_semi")
        total = kept.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return replace(self, n=total["n"], avgdl=total["avgdl"], keep=kept.select("chunk_id"))


def _tokenised(chunks: DataFrame) -> DataFrame:
    keep = [c for c in chunks.columns if c not in ("text", "links")]
    toks, heads = tokens(F.col("text")).alias("toks"), tokens(F.coalesce("heading", F.lit(""))).alias("heads")
    fields = field_terms(F.col("note_path"), F.col("aliases"), F.col("heading_path")).alias("fields")
    return chunks.select(*keep, F.coalesce(toks, F.array().cast("array<string>")).alias("toks"), heads, fields).withColumn("dl", F.size("toks"))


def _postings(tokenised: DataFrame) -> DataFrame:
    """A chunk is one row, so its terms are counted where it lies: no shuffle if the rows are already spread by chunk_id."""

    def kinds(name: str, kind: int):
        return F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))

    each = tokenised.select("chunk_id", "note_path", "dl", F.explode(F.concat(kinds("toks", 0), kinds("heads", 1), kinds("fields", 2))).alias("x")).select("chunk_id", "note_path", "dl", "x.term", "x.kind")
    counted = each.groupBy("chunk_id", "note_path", "dl", "term").agg(
        F.count(F.when(F.col("kind") == 0, 1)).cast("int").alias("tf"), (F.count(F.when(F.col("kind") == 1, 1)) > 0).alias("in_head"), (F.count(F.when(F.col("kind") == 2, 1)) > 0).alias("in_field")
    )
    return counted.select("term", "chunk_id", "note_path", "dl", "tf", "in_head", "in_field")


def build(chunks: DataFrame, buckets: int | None = None) -> Index:
    """The index of distinct chunks, written once to the shared folder.

    Facts and postings are bucketed by chunk_id (as many buckets as shuffle partitions if None): the terms of a chunk lie in
    one file, so scores add up and pages are cut there before anything moves; within a file they are sorted by term, so the
    terms of the queries prune what is read."""
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df: DataFrame, kind: str, order: str) -> DataFrame:
        name = f"marginalia_{kind}_{uuid.uuid4().hex}"
        try:
            df.write.bucketBy(buckets, "chunk_id").sortBy(order).option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
        except AnalysisException:  # a session whose catalog cannot take tables: the same rows, without buckets
            return materialize(df.sortWithinPartitions(order), kind)
        return spark.table(name)

    base = written(_tokenised(chunks).repartition(buckets, "chunk_id"), "chunks", "chunk_id")
    postings = written(_postings(base), "postings", "term")
    df = materialize(postings.where("tf > 0").groupBy("term").agg(F.count("*").alias("df")), "term-df")
    facts = base.drop("toks", "heads", "fields")
    total = facts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return Index(facts, postings, df, total["n"], total["avgdl"])


def as_index(chunks: DataFrame | Index) -> Index:
    """The index itself, or one over a table of distinct chunks that is not written (for small tables)."""
    if isinstance(chunks, Index):
        return chunks
    base = _tokenised(chunks)
    postings = _postings(base)
    total = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return Index(base.drop("toks", "heads", "fields"), postings, postings.where("tf > 0").groupBy("term").agg(F.count("*").alias("df")), total["n"], total["avgdl"])


def idf(df: Column, n: int) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def search_scores(chunks: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, note_path, score of every chunk with a positive score.

    The statistics are those of the chunks searched. A body term adds its BM25 part, more if it stands in the chunk's
    heading; a term that only name, aliases or ancestors have adds its idf. One join of the query terms (broadcast up to
    MOST_BROADCAST_TERMS) with the postings, then a sum by chunk.
    """
    index = as_index(chunks)
    asked = query_terms(queries)
    hint = F.broadcast if asked.count() <= MOST_BROADCAST_TERMS else (lambda df: df)
    terms = asked.select("term").distinct()
    postings, known = index.postings, index.df
    if index.keep is not None:
        postings = postings.join(hint(terms), "term", "left_semi").join(index.keep, "chunk_id", "left_semi")
        known = postings.where("tf > 0").groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(known.join(hint(terms), "term", "left_semi"), "term", "left").select("term", idf(F.coalesce("df", F.lit(0)), index.n).alias("idf"))
    part = F.when(
        F.col("tf") > 0,
        F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl))) * F.when(F.col("in_head"), HEADING).otherwise(1.0),
    ).when(F.col("in_field"), F.col("idf"))
    scored = postings.join(hint(asked.join(weights, "term")), "term").select("query_id", "chunk_id", "note_path", part.alias("part")).where("part is not null")
    return scored.groupBy("query_id", "chunk_id", "note_path").agg(F.sum("part").alias("score")).where("score > 0")


def search(chunks: DataFrame | Index, queries: DataFrame, limit: int = 8, cap: int | None = None) -> DataFrame:
    """The page of every query: query_id, rank, chunk_id, note_path, score, matched (the query's terms the chunk has)."""
    index = as_index(chunks)
    page = diversified(search_scores(index, queries), limit, cap)
    # only the chunks on a page are looked at again for the terms they match
    asked = page.join(query_terms(queries), "query_id")
    has = index.postings.where("tf > 0 or in_field").select("term", "chunk_id")
    matched = asked.join(has, ["chunk_id", "term"]).groupBy("query_id", "rank", "chunk_id", "note_path", "score").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    return matched.select("query_id", "rank", "chunk_id", "note_path", "score", "matched")
